"""Bringing rows of titles and people together under one id, with all that points to them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinomill.functions.text import trimmed
from kinomill.operators.catalog import identity_map, merge_rows, repoint, resolved_ids, union_lists, unique_by_name, with_owner


def upsert_by_ids(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Mapping[str, str]) -> DataFrame:
    """``existing`` after ``incoming`` is merged into it: a row goes to the row that the first matching of ``keys`` names, else it is new.

    Incoming rows without ``id`` or with a blank name (the first column of ``keep``) are
    left out.  Several incoming rows that lead to one id are folded in the order of their
    ids before they are merged, so that the last value that counts stays.  A list column is the union of both.
    """
    name = next(iter(keep))
    sound = incoming.filter((trimmed(F.col("id")) != "") & (trimmed(F.col(name)) != ""))
    led = resolved_ids(sound, existing, keys)
    folded = led.groupBy("canonical").agg(*(_last(rule, F.col(column), F.col("id")).alias(column) for column, rule in keep.items())).withColumnRenamed("canonical", "id")
    plain = {column: rule for column, rule in keep.items() if rule != "union"}
    merged = merge_rows(existing, folded, "id", plain)
    for column in (c for c, rule in keep.items() if rule == "union"):
        old, new = existing.select("id", F.col(column).alias("_old")), folded.select("id", F.col(column).alias("_new"))
        merged = merged.join(old, "id", "left").join(new, "id", "left").withColumn(column, union_lists(F.col("_old"), F.col("_new"))).drop("_old", "_new")
    return merged.select("id", *keep)


def _last(rule: str, column: Column, order: Column) -> Column:
    """Of the values of a group, the last one in order that the rule counts; of lists their union in order."""
    if rule == "union":
        lists = F.sort_array(F.collect_list(F.struct(order.alias("order"), column.alias("value"))))
        return F.array_distinct(F.flatten(F.transform(lists, lambda x: F.coalesce(x["value"], F.array().cast("array<string>")))))
    counts = {"given": column.isNotNull(), "text": trimmed(column) != "", "positive": column > 0, "list": F.size(column) > 0, "always": F.lit(True)}[rule]
    return F.max_by(column, F.when(counts, order))


def consolidate(rows: DataFrame, keys: Sequence[str], keep: Sequence[str], children: Mapping[str, tuple[DataFrame, str, Sequence[str]]]) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Rows that share a value of any key, directly or through others, become the row of the smallest id.

    Of each column of ``keep`` the first value that is neither null nor blank counts, in
    the order of the ids, so the canonical row's own values come first.  ``children``
    are tables with the column that points to a row and their key; they are led to the
    canonical row, and rows made equal by that are kept once.  Gives the rows, the
    children and the map of ids.
    """
    ids = identity_map(rows, keys)
    led = rows.join(ids, "id")
    merged = led.groupBy("canonical").agg(*(F.min_by(c, F.when(F.col(c).isNotNull() & (trimmed(F.col(c).cast("string")) != ""), F.col("id"))).alias(c) for c in keep)).withColumnRenamed("canonical", "id")
    return merged, {name: repoint(table, ids, column, key) for name, (table, column, key) in children.items()}, ids


def repair_duplicates(people: DataFrame, external: str, name: str, children: Mapping[str, tuple[DataFrame, str, Sequence[str]]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """People without external id go into the one person with an external id of their name; where several have that name both stay."""
    has_id = trimmed(F.coalesce(F.col(external), F.lit(""))) != ""
    ids = unique_by_name(people.filter(~has_id), people.filter(has_id), name).filter("id <> canonical")
    return people.join(ids.select("id"), "id", "left_anti"), {n: repoint(table, ids, column, key) for n, (table, column, key) in children.items()}


def canonical_people(incoming: DataFrame, people: DataFrame, cast: DataFrame) -> DataFrame:
    """``incoming`` (``id``, ``title_id``, ``imdb_id``, ``tmdb_id``, ``name``) with ``canonical`` and ``tier``; rows that match nobody drop out.

    Only people with an IMDb id count.  Tier 1 is the IMDb id, tier 2 the TMDB id, tier 3
    the name, normalized in ``people`` as ``name``, where the cast of the title has
    exactly one person of it.
    """
    known = people.filter(trimmed(F.coalesce("imdb_id", F.lit(""))) != "")
    by_imdb = known.groupBy(F.lower(trimmed(F.col("imdb_id"))).alias("_imdb")).agg(F.min("id").alias("_1"))
    by_tmdb = known.filter("tmdb_id > 0").groupBy(F.col("tmdb_id").alias("_tmdb")).agg(F.min("id").alias("_2"))
    named = cast.join(known.select(F.col("id").alias("person_id"), F.col("name").alias("_name")), "person_id").filter("_name <> ''")
    by_name = named.groupBy(F.col("title_id").alias("_title"), "_name").agg(F.count_distinct("person_id").alias("_n"), F.min("person_id").alias("_3")).filter("_n = 1").drop("_n")
    rows = incoming.join(by_imdb, F.lower(trimmed(F.col("imdb_id"))) == F.col("_imdb"), "left").join(by_tmdb, F.col("tmdb_id") == F.col("_tmdb"), "left")
    rows = rows.join(by_name, (F.col("title_id") == F.col("_title")) & (F.col("name") == F.col("_name")), "left")
    tier = F.when(F.col("_1").isNotNull(), 1).when(F.col("_2").isNotNull(), 2).when(F.col("_3").isNotNull(), 3)
    return rows.select(*incoming.columns, F.coalesce("_1", "_2", "_3").alias("canonical"), tier.alias("tier")).filter("canonical IS NOT NULL")


def canonical_images(images: DataFrame, people: DataFrame) -> DataFrame:
    """``images`` (``image_id``, ``tmdb_id``, ``place``) led to ``person_id`` by the TMDB id of matched ``people`` (``tmdb_id``, ``canonical``); unmatched ones drop out, and of rows of one image the first place counts."""
    owners = people.filter("tmdb_id > 0").groupBy("tmdb_id").agg(F.min("canonical").alias("person_id"))
    first = images.groupBy("image_id").agg(F.min(F.struct("place", "tmdb_id")).alias("_f")).select("image_id", "_f.tmdb_id")
    return first.join(owners, "tmdb_id").select("image_id", "person_id")


def person_ids(asked: DataFrame, people: DataFrame) -> DataFrame:
    """``asked`` ids with ``canonical``: a known id itself, ``person:tmdb:N`` by its TMDB id, anything else itself."""
    number = F.regexp_extract("id", r"^person:tmdb:(\d+)$", 1).try_cast("int")
    own = people.select(F.col("id").alias("_own")).distinct()
    by_tmdb = people.filter("tmdb_id > 0").groupBy(F.col("tmdb_id").alias("_tmdb")).agg(F.min("id").alias("_by"))
    rows = asked.join(own, F.col("id") == F.col("_own"), "left").join(by_tmdb, number == F.col("_tmdb"), "left")
    return rows.select(*asked.columns, F.coalesce("_own", "_by", "id").alias("canonical"))


def import_catalogue(titles: DataFrame, alternates: DataFrame, cast: DataFrame, people: DataFrame, stored: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """A whole import: ``titles``, ``alternates``, ``cast`` and ``people`` merged into what is ``stored`` under these names, and counters.

    Titles and people are updated by id; alternates of the titles that come are replaced;
    cast rows are added where their key (``title_id``, ``person_id``, ``place``) is new;
    then people without external id are repaired by name and cast rows whose title or
    person is missing are removed.  Nothing is written: a caller that fails half way has
    changed nothing.  Raises ValueError if a title or a person lacks an id or a name.
    """
    for rows, key, name in ((titles, "title_id", "title"), (people, "id", "name")):
        bad = rows.filter((trimmed(F.coalesce(key, F.lit(""))) == "") | (trimmed(F.coalesce(name, F.lit(""))) == ""))
        if not bad.isEmpty():
            raise ValueError(f"{key} and {name} are required")
    newest = lambda rows, key: rows.groupBy(key).agg(F.max(F.struct(*(c for c in rows.columns if c != key))).alias("_r")).select(key, "_r.*")
    put = lambda old, new, key: old.join(new.select(key).distinct(), key, "left_anti").unionByName(newest(new, key).select(*old.columns))
    all_titles, all_people = put(stored["titles"], titles, "title_id"), put(stored["people"], people, "id")
    kept = stored["alternates"].join(titles.select("title_id").distinct(), "title_id", "left_anti")
    all_alternates = kept.unionByName(with_owner(alternates.select(*kept.columns), titles, "title_id").distinct())
    key = ["title_id", "person_id", "place"]
    fresh = cast.select(*key).distinct().join(stored["cast"].select(*key), key, "left_anti")
    before = stored["cast"].select(*key).unionByName(fresh)
    repaired, led = repair_duplicates(all_people, "external_id", "name", {"cast": (before, "person_id", key)})
    whole = with_owner(with_owner(led["cast"], all_titles, "title_id"), repaired.select(F.col("id").alias("person_id")), "person_id")
    after = {"titles": all_titles, "people": repaired, "alternates": all_alternates, "cast": whole}
    counted = {
        "titles": titles.select("title_id").distinct(), "people": people.select("id").distinct(), "alternates": all_alternates.join(titles.select("title_id").distinct(), "title_id", "left_semi"),
        "cast_added": fresh, "people_merged": all_people.join(repaired.select("id"), "id", "left_anti"), "cast_kept": whole,
    }
    counts = None
    for name, rows in counted.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        counts = one if counts is None else counts.unionAll(one)
    return after, counts


def last_written(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Plain overwriting by id, without any matching: of the incoming rows of a key the last in order, whole, in place of the old one."""
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    fresh = incoming.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(*existing.columns)
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def by_folded_id(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    """Rows whose id equals the wanted one apart from case and white space around it; a blank one finds nothing."""
    asked = trimmed(F.lit(wanted))
    return rows.filter((asked != "") & (F.lower(trimmed(F.col(column))) == F.lower(asked)))
