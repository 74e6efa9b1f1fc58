"""Matching faces to people and choosing reference images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinomill.functions.vectors import cosine, inner_product, mean_of_top
from kinomill.lineage import cut

MATCH, MARGIN, DETECTION, REFERENCES, TOP = 0.45, 0.05, 0.6, 10, 3
#: Faces and references that a task compares, about; groups and faces that are broadcast at most; similarities held at once.
FACES, PEOPLE, LARGE, CELLS = 1024, 4096, 100_000, 2_000_000
#: Inner products between which single precision neither loses nor overflows.
TINY, HUGE = 1e-20, 1e30


def first_references(vectors: DataFrame, n: int = REFERENCES) -> DataFrame:
    """The first ``n`` vectors of each person by quality and id."""
    order = Window.partitionBy("person_id").orderBy(F.desc("quality"), "vector_id")
    return vectors.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def eligible_faces(faces: DataFrame, least: float = DETECTION) -> DataFrame:
    return faces.filter((F.col("det_score") >= F.lit(least).cast("float")) & (F.size("embedding") > 0))


def _similarities(a: np.ndarray, b: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """:func:`kinomill.functions.vectors.cosine` of vectors along the first axis; -1 where ``squares`` is zero."""
    total = np.zeros(squares.shape)
    product = np.empty(squares.shape, np.float32)
    for x, y in zip(a, b, strict=True):
        np.multiply(x, y, out=product)
        np.add(total, product, out=total)
    value = total / np.sqrt(squares)
    value = np.maximum(-1.0, np.minimum(1.0, np.where(np.isnan(value), 1.0, value)))  # Spark takes NaN for the greatest
    return np.where(squares != 0, value, -1.0).astype(np.float32)


def _means(similarities: np.ndarray, above: float = -1.0) -> np.ndarray:
    """The mean of the :data:`TOP` highest values of the last axis that are above a bound, else -1; summed in double precision."""
    if similarities.shape[-1] > TOP:
        similarities = np.partition(similarities, similarities.shape[-1] - TOP, axis=-1)[..., -TOP:]
    best = np.sort(similarities, axis=-1)[..., ::-1].astype(np.float64)
    good = best > above
    n = good.sum(-1)
    return np.where(n > 0, np.where(good, best, 0.0).sum(-1) / np.maximum(n, 1), -1.0).astype(np.float32)


def _block_scores(faces: np.ndarray, aa: np.ndarray, references: np.ndarray, bb: np.ndarray, ends: np.ndarray, most: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each face the numbers of people and their scores; with ``most`` only people who could have one of that many highest. ``ends`` is where the rows of each person end."""
    starts = np.concatenate([[0], ends[:-1]])
    width = int((ends - starts).max())
    places = np.minimum(starts[:, None] + np.arange(width), len(references) - 1)
    absent = np.arange(width) >= (ends - starts)[:, None]
    usual = bool(((aa > TINY) & (aa < HUGE)).all() and ((bb == 0) | ((bb > TINY) & (bb < HUGE))).all())
    rough_first = most is not None and most < len(ends) and usual
    columns = np.ascontiguousarray(references.T)
    if rough_first:
        unit_faces = (faces / np.sqrt(aa)[:, None]).astype(np.float32)
        unit_references = (references / np.sqrt(np.where(bb > 0, bb, 1.0))[:, None]).astype(np.float32)
    off = 1e-5 + faces.shape[1] * 2.0**-22  # more than single precision can move a similarity of units, or a mean of them
    step = max(1, CELLS // (width * len(ends)))
    for start in range(0, len(faces), step):
        own, square = faces[start : start + step], aa[start : start + step]
        if not rough_first:
            similarities = np.empty((len(own), len(references)), np.float32)
            for r in range(0, len(own), 64):  # blocks that stay in the cache
                for c in range(0, len(references), 256):
                    similarities[r : r + 64, c : c + 256] = _similarities(own[r : r + 64].T[:, :, None], columns[:, None, c : c + 256], square[r : r + 64, None] * bb[None, c : c + 256])
            for n, scores in enumerate(_means(np.where(absent, np.float32(-2), similarities[:, places]))):
                yield start + n, np.arange(len(ends)), scores
            continue
        rough = np.where(bb != 0, unit_faces[start : start + step] @ unit_references.T, np.float32(-2))
        rough = np.where(absent, np.float32(-2), rough[:, places])
        means = _means(rough, -1.5)
        enough = -np.partition(-means, most - 1, axis=1)[:, most - 1 : most] - 2 * off
        # a similarity near -1 may be left out of the mean or not
        near, people = np.nonzero((means >= enough) | ((rough > -1.5) & (rough <= off - 1)).any(2))
        scores = np.empty(len(near), np.float32)
        for part in np.array_split(np.arange(len(near)), len(near) * width // 65_536 + 1):
            f, who = near[part], people[part]
            exact = _similarities(own[f].T[:, :, None], columns[:, places[who]], square[f, None] * bb[places[who]])
            scores[part] = _means(np.where(absent[who], np.float32(-2), exact))
        cuts = np.searchsorted(near, np.arange(len(own) + 1))
        for n in range(len(own)):
            yield start + n, people[cuts[n] : cuts[n + 1]], scores[cuts[n] : cuts[n + 1]]


def _sized(rows: pa.Table, vector: str, square: str) -> tuple[np.ndarray, np.ndarray]:
    """The length of each vector, 0 for one that has no similarity, and its inner product with itself."""
    squares = np.array(rows.column(square).to_pylist(), np.float64)  # nulls of vectors with nulls become NaN
    known = np.array(rows.column(square).is_valid().to_pylist(), bool)
    return np.where(known, np.array(pc.fill_null(pc.list_value_length(rows.column(vector)), 0).to_pylist(), np.int64), 0), squares


def _matrix(rows: pa.Table, vector: str, which: np.ndarray, dimensions: int) -> np.ndarray:
    flat = rows.column(vector).take(pa.array(which)).combine_chunks().flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float32).reshape(len(which), dimensions)


def _scored(most: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores of a block of faces (``face_id``, ``scene_id``, ``embedding``, ``_a``) with a block of people (``person_id``, ``vector``, ``_b``)."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        if left.num_rows and right.num_rows:
            right = right.take(pc.sort_indices(right, sort_keys=[("person_id", "ascending")]))
            person = right.column("person_id").to_pylist()
            ends = np.array([i for i in range(1, len(person) + 1) if i == len(person) or person[i] != person[i - 1]])
            (of_faces, aa), (of_references, bb) = _sized(left, "embedding", "_a"), _sized(right, "vector", "_b")
            for d in np.unique(of_faces).tolist():
                rows, fit = np.flatnonzero(of_faces == d), np.flatnonzero((of_references == d) & (d > 0))
                if not len(fit):
                    found += [(np.full(len(ends), n), ends - 1, np.full(len(ends), -1, np.float32)) for n in rows]
                    continue
                references, squares = np.zeros((len(person), d), np.float32), np.zeros(len(person))
                references[fit], squares[fit] = _matrix(right, "vector", fit, d), bb[fit]
                with np.errstate(all="ignore"):
                    found += [(np.full(len(who), rows[n]), ends[who] - 1, scores) for n, who, scores in _block_scores(_matrix(left, "embedding", rows, d), aa[rows], references, squares, ends, most)]
        face, who, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        columns = {"face_id": left.column("face_id").take(pa.array(face)), "scene_id": left.column("scene_id").take(pa.array(face)), "person_id": right.column("person_id").take(pa.array(who))}
        return pa.table(columns | {"score": pa.array(scores)})

    return score


def person_scores(faces: DataFrame, references: DataFrame, group: str, most: int | None = None) -> DataFrame:
    """``face_id``, ``scene_id``, ``person_id``, ``score``: the mean of the best :data:`TOP` similarities of a face to a person's references within the same ``group``.

    The references of a group are those of its cast, at most :data:`REFERENCES` a person.
    A large group is cut into blocks of faces and blocks of people, and a task compares
    one with one.  With ``most`` only people who could be among that many first of a
    face need be there; a few others may.
    """
    faces = faces.filter(F.col(group).isNotNull()).select(F.col(group).alias("_g"), "face_id", "scene_id", "embedding").withColumn("_a", inner_product(F.col("embedding"), F.col("embedding")))
    references = references.filter(F.col(group).isNotNull()).select(F.col(group).alias("_g"), "person_id", "vector").withColumn("_b", inner_product(F.col("vector"), F.col("vector")))
    # a face of several rows has one score for a person from all of them
    several = cut(faces.groupBy("face_id").count().filter("count > 1").select("face_id"))
    repeated = several.count()
    once = faces.join(F.broadcast(several) if repeated <= LARGE else several, "face_id", "left_anti") if repeated else faces
    blocks = lambda rows, most: rows.groupBy("_g").agg(F.ceil(F.count("*") / most).cast("int").alias("n"))
    sizes = blocks(once, FACES).withColumnRenamed("n", "_fs").join(blocks(references, PEOPLE).withColumnRenamed("n", "_rs"), "_g")
    large = cut(sizes.filter("_fs > 1 OR _rs > 1"))
    if large.count() <= LARGE:
        large = F.broadcast(large)
    own = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    asked = once.join(large, "_g", "left").select("_g", own("face_id", "_fs").alias("_f"), every("_rs").alias("_r"), "face_id", "scene_id", "embedding", "_a")
    known = references.join(large, "_g", "left").select("_g", every("_fs").alias("_f"), own("person_id", "_rs").alias("_r"), "person_id", "vector", "_b")
    kinds = {f.name: f.dataType.simpleString() for f in (*faces.schema, *references.schema)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("face_id", "scene_id", "person_id")) + ", score float"
    by = ["_g", "_f", "_r"]
    scores = asked.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(_scored(most), schema)
    if not repeated:
        return scores
    similarity = cosine(F.col("embedding"), F.col("vector"), -1.0, F.col("_a") * F.col("_b"))
    pairs = faces.join(several, "face_id", "left_semi").join(references, "_g").select("face_id", "scene_id", "person_id", similarity.alias("s"))
    best = Window.partitionBy("face_id", "person_id").orderBy(F.desc("s"))
    top = pairs.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= TOP)
    return scores.unionAll(top.groupBy("face_id", "scene_id", "person_id").agg(mean_of_top(F.collect_list("s"), TOP).alias("score")))


def decided(scores: DataFrame, match: float = MATCH, margin: float = MARGIN) -> DataFrame:
    """The best person of each face where it is good enough and far enough ahead of the next; ties by id."""
    order = Window.partitionBy("face_id").orderBy(F.desc("score"), "person_id")
    ranked = scores.withColumn("_n", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("score").over(order), F.lit(-1.0).cast("float")))
    first = ranked.filter("_n = 1").drop("_n")
    return first.filter((F.col("score") >= F.lit(match).cast("float")) & (F.col("score") - F.col("second") >= F.lit(margin).cast("float")))


def scene_people(matches: DataFrame) -> DataFrame:
    return matches.groupBy("scene_id", "person_id").agg(F.count("*").alias("match_count"), F.max("score").alias("best_score")).withColumn("confidence", F.col("best_score"))


def tag_faces(faces: DataFrame, references: DataFrame, group: str) -> DataFrame:
    """The people of each scene, from its faces and the references of the cast."""
    return scene_people(decided(person_scores(eligible_faces(faces), first_references(references), group, 2)))


def reference_candidates(images: DataFrame, vectors: DataFrame) -> DataFrame:
    """Images that have a place, were not rejected and have no vector yet."""
    placed = (F.trim(F.coalesce("source_url", F.lit(""))) != "") | (F.trim(F.coalesce("local_path", F.lit(""))) != "")
    return images.filter(placed & (F.col("status") != "rejected")).join(vectors.select("image_id").distinct(), "image_id", "left_anti")


def evenly_spread(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """Up to ``k`` rows of each group, spread evenly over its order, with the first and the last."""
    window = Window.partitionBy(group)
    numbered = rows.withColumn("_i", F.row_number().over(window.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(window))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / max(1, k - 1)))
    return numbered.filter((F.col("_n") <= k) | F.array_contains(places, F.col("_i").cast("bigint"))).drop("_i", "_n")


def ingestion_state(detected: Column, least: float = DETECTION) -> Column:
    """``ready`` for an image with exactly one face of enough certainty, else ``rejected``; ``detected`` is an array of scores."""
    return F.when(F.size(F.filter(detected, lambda s: s >= least)) == 1, F.when(F.size(detected) == 1, "ready").otherwise("rejected")).otherwise("rejected")
