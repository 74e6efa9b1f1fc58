"""Importing, joining and consolidating the catalogue of titles and people."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinomill.functions.text import trimmed
from kinomill.lineage import cut
from kinomill.operators.search import catalog_limit


def select_titles(
    titles: DataFrame, allowed: DataFrame | None = None, title_type: str | None = "movie", include_adult: bool = True, first_year: int | None = None, last_year: int | None = None, most: int = 0
) -> DataFrame:
    """Titles by type, list, adult mark and year (a missing year fails a bound); then the first ``most`` in file order."""
    if title_type is not None:
        titles = titles.filter(F.col("title_type") == title_type)
    if not include_adult:
        titles = titles.filter(~F.col("is_adult"))
    if first_year is not None:
        titles = titles.filter(F.col("year") >= first_year)
    if last_year is not None:
        titles = titles.filter(F.col("year") <= last_year)
    if allowed is not None:
        titles = titles.join(allowed, "title_id", "left_semi")
    return titles.orderBy("line_no").limit(most) if most > 0 else titles


def with_ratings(titles: DataFrame, ratings: DataFrame) -> DataFrame:
    joined = titles.join(ratings, "title_id", "left")
    return joined.withColumns({"average_rating": F.coalesce("average_rating", F.lit(0).cast("float")), "vote_count": F.coalesce("vote_count", F.lit(0).cast("bigint"))})


def distinct_in_order(order: Sequence[str], value: str) -> Column:
    """An aggregate: the values in order, each once. One list for each group, so groups are to be of moderate size, as a title's names are."""
    pairs = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return F.array_distinct(F.transform(pairs, lambda x: x["_value"]))


def with_alternates(titles: DataFrame, alternates: DataFrame) -> DataFrame:
    names = alternates.groupBy("title_id").agg(distinct_in_order(["ordering", "title"], "title").alias("alternate_titles"))
    return titles.join(names, "title_id", "left").withColumn("alternate_titles", F.coalesce("alternate_titles", F.array().cast("array<string>")))


def cast_of(titles: DataFrame, principals: DataFrame, names: DataFrame) -> DataFrame:
    """Cast rows of the titles; a row whose person has no name drops out."""
    known = names.join(principals.select("name_id").distinct(), "name_id", "left_semi").filter(trimmed(F.col("name")) != "")
    return principals.join(titles.select("title_id"), "title_id", "left_semi").join(known, "name_id")


def people_of_cast(cast: DataFrame, title: str = "title_id", person: str = "name_id", order: str = "ordering") -> DataFrame:
    """One row for each person of a title, the first in cast order."""
    first = Window.partitionBy(title, person).orderBy(order)
    return cast.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def merge_rows(existing: DataFrame, incoming: DataFrame, key: str, keep: Mapping[str, str]) -> DataFrame:
    """A full merge by key. ``keep`` says for each column when the new value counts: ``given`` (not null), ``text`` (not blank), ``positive``, ``list`` (not empty) or ``always``."""
    rules = {
        "given": lambda c: c,
        "text": lambda c: F.when(trimmed(c) != "", c),
        "positive": lambda c: F.when(c > 0, c),
        "list": lambda c: F.when(F.size(c) > 0, c),
    }
    old, new = existing.alias("old"), incoming.alias("new")
    both = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full")
    columns = [F.coalesce(f"new.{key}", f"old.{key}").alias(key)]
    for name, rule in keep.items():
        before, after = F.col(f"old.{name}"), F.col(f"new.{name}")
        if rule == "always":
            columns.append(F.when(F.col(f"new.{key}").isNotNull(), after).otherwise(before).alias(name))
        else:
            columns.append(F.coalesce(rules[rule](after), before).alias(name))
    return both.select(*columns)


def union_lists(old: Column, new: Column) -> Column:
    """Old members, then new ones that are not blank, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(old, none), F.filter(F.coalesce(new, none), lambda x: x != "")))


def merge_maps(old: Column, new: Column) -> Column:
    """Members of both; the new value of a common key. Null where both are empty."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    both = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    return F.when(F.size(both) > 0, both)


def resolved_ids(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``incoming`` with ``canonical``: the existing id found by the first of ``keys`` that matches, else its own."""
    found = []
    for i, key in enumerate(keys):
        usable = F.col(key).isNotNull() & ((F.col(key) != 0) if dict(existing.dtypes)[key] in ("int", "bigint") else (trimmed(F.col(key)) != ""))
        side = existing.filter(usable).groupBy(F.col(key).alias(f"_k{i}")).agg(F.min("id").alias(f"_c{i}"))
        incoming = incoming.join(side, F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(F.col(f"_c{i}"))
    return incoming.withColumn("canonical", F.coalesce(*found, "id")).drop(*(f"_c{i}" for i in range(len(keys))))


def identity_map(rows: DataFrame, keys: Sequence[str], rounds: int | None = None) -> DataFrame:
    """``id`` and ``canonical``: rows that share a non-blank value of any key, directly or through others, get the smallest id.

    Every round passes the smallest id of each key on to all of its rows and on to the
    rows' own label holders; the rounds needed grow with the logarithm of the longest
    chain.  Keys are aggregated before they are joined, so a key in a third of all rows
    costs one row of the aggregate for each partition.  Rounds go on until nothing moves;
    if ``rounds`` is given and something still moves in the last, RuntimeError is raised.
    """
    pairs = None
    for i, key in enumerate(keys):
        text = F.col(key).cast("string")
        part = rows.filter(text.isNotNull() & ~trimmed(text).isin("", "0")).select("id", F.concat(F.lit(f"{i}:"), text).alias("key"))
        pairs = part if pairs is None else pairs.unionAll(part)
    pairs = cut(pairs.distinct())
    labels = rows.select("id", F.col("id").alias("label")).distinct()
    for done in itertools.count(1):
        by_key = pairs.join(labels, "id").groupBy("key").agg(F.min("label").alias("label"))
        best = pairs.join(by_key, "key").groupBy("id").agg(F.min("label").alias("best"))
        jump = labels.select(F.col("id").alias("best"), F.col("label").alias("far"))
        moved = labels.join(best, "id", "left").withColumn("best", F.coalesce("best", "label")).join(jump, "best", "left")
        moved = cut(moved.select("id", F.least("label", "best", F.coalesce("far", "best")).alias("new"), F.col("label").alias("old")))
        labels = moved.select("id", F.col("new").alias("label"))
        if moved.filter("new <> old").isEmpty():
            break
        if done == rounds:
            raise RuntimeError(f"identities are not settled after {rounds} rounds")
    return labels.withColumnRenamed("label", "canonical")


def repoint(rows: DataFrame, ids: DataFrame, column: str, key: Sequence[str]) -> DataFrame:
    """Rows with ``column`` led to its canonical id; where that makes keys equal, the row that had the canonical id stays, else the smallest."""
    led = rows.join(ids.select(F.col("id").alias(column), "canonical"), column, "left").withColumn("_own", F.coalesce(F.col("canonical") != F.col(column), F.lit(False)))
    led = led.withColumn(column, F.coalesce("canonical", column)).drop("canonical")
    rest = [c for c in rows.columns if c not in key]
    best = Window.partitionBy(*key).orderBy("_own", *rest)
    return led.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(*rows.columns)


def unique_by_name(bare: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """``id`` of a row without external id and ``canonical``, the one known row with its name; names of none or several give nothing."""
    single = known.filter(F.col(name) != "").groupBy(name).agg(F.countDistinct("id").alias("n"), F.min("id").alias("canonical")).filter("n = 1")
    return bare.join(single, name).select("id", "canonical")


def replace_children(existing: DataFrame, incoming: DataFrame, parent: Sequence[str], key: Sequence[str]) -> DataFrame:
    """All children of the parents in ``incoming`` give way to the new ones, each key once (the smallest row of it)."""
    parents = incoming.select(*parent).distinct()
    rest = [c for c in existing.columns if c not in key]
    first = Window.partitionBy(*key).orderBy(*rest) if rest else Window.partitionBy(*key).orderBy(*key)
    fresh = incoming.select(*existing.columns).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return existing.join(parents, list(parent), "left_anti").unionByName(fresh)


def insert_missing(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is new; existing rows stay as they are."""
    rest = [c for c in existing.columns if c not in key]
    fresh = incoming.select(*existing.columns).join(existing.select(*key), list(key), "left_anti")
    first = Window.partitionBy(*key).orderBy(*(rest or key))
    return existing.unionByName(fresh.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n"))


def with_owner(rows: DataFrame, owners: DataFrame, column: str) -> DataFrame:
    return rows.join(owners.select(column).distinct(), column, "left_semi")


def without_owner(rows: DataFrame, owners: DataFrame, column: str) -> DataFrame:
    return rows.join(owners.select(column).distinct(), column, "left_anti")


def ready_people(persons: DataFrame, vectors: DataFrame, least: int, cast: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """People with at least ``least`` vectors; of the cast of some titles only, if these are given (none for no titles)."""
    enough = vectors.groupBy("person_id").count().filter(F.col("count") >= least)
    ready = persons.join(enough.select("person_id"), "person_id", "left_semi")
    if titles is not None:
        ready = ready.join(cast.join(titles.select("title_id").distinct(), "title_id", "left_semi").select("person_id").distinct(), "person_id", "left_semi")
    return ready


def bank_status(cast: DataFrame, vectors: DataFrame, least: int) -> DataFrame:
    """For each title the people ready, the ids still missing in order, and whether all are ready (a title without cast is partial)."""
    enough = vectors.groupBy("person_id").count().filter(F.col("count") >= least).select("person_id", F.lit(True).alias("ready"))
    people = cast.filter("person_id <> ''").select("title_id", "person_id").distinct().join(enough, "person_id", "left")
    state = people.groupBy("title_id").agg(
        F.count("*").alias("people"), F.count("ready").alias("ready"), F.sort_array(F.collect_list(F.when(F.col("ready").isNull(), F.col("person_id")))).alias("missing")
    )
    return state.withColumn("status", F.when(F.col("ready") == F.col("people"), "complete").otherwise("partial"))


def search_titles(titles: DataFrame, query: str, limit: int, alternates: DataFrame | None = None) -> DataFrame:
    """Titles that contain a text in either name (or in an alternate one): equal names first, then those that begin so, then by name and year; 20 for no limit, 100 at most."""
    own = F.col("normalized_title").contains(query) | F.col("normalized_original_title").contains(query)
    found = titles.filter(own) if query else titles
    if alternates is not None and query:
        named = alternates.filter(F.lower("title").contains(query)).select("title_id").distinct()
        found = found.unionByName(titles.join(named, "title_id", "left_semi").filter(~F.coalesce(own, F.lit(False))))
    exact = (F.col("normalized_title") == query) | (F.col("normalized_original_title") == query)
    begins = F.col("normalized_title").startswith(query) | F.col("normalized_original_title").startswith(query)
    rank = F.when(exact, 0).when(begins, 1).otherwise(2)
    return found.withColumn("rank", rank).orderBy("rank", "normalized_title", F.asc_nulls_first("year"), "title_id").limit(catalog_limit(limit))


def titles_by_exact_name(titles: DataFrame, alternates: DataFrame, variants: Sequence[str], limit: int) -> DataFrame:
    """Of the titles one of whose names is one of the variants the first ``limit`` by id (20 for none, 100 at most); of these the latest first."""
    ids = titles.filter(F.col("title").isin(*variants) | F.col("original_title").isin(*variants)).select("title_id")
    ids = ids.union(alternates.filter(F.col("title").isin(*variants)).select("title_id")).distinct()
    ids = ids.orderBy("title_id").limit(catalog_limit(limit))
    return titles.join(F.broadcast(ids), "title_id", "left_semi").orderBy(F.desc(F.coalesce("year", F.lit(0))), "title_id")


def find_title(titles: DataFrame, alternates: DataFrame, name: str, year: int | None = None) -> DataFrame:
    """At most one title of a normalized name: the earliest, or with a year one of that year before one of none."""
    named = alternates.filter(F.lower("title") == name).select("title_id").distinct().withColumn("_alias", F.lit(True))
    found = titles.join(named, "title_id", "left").filter((F.col("normalized_title") == name) | (F.col("normalized_original_title") == name) | F.col("_alias")).drop("_alias")
    if year is not None:
        found = found.filter(F.col("year").isNull() | (F.col("year") == year))
    return found.orderBy(F.asc_nulls_last("year"), "title_id").limit(1)


def search_people(persons: DataFrame, query: str, limit: int) -> DataFrame:
    """People whose name, id or one of whose aliases contains a text; 20 for no limit, 100 at most."""
    hit = F.col("normalized_name").contains(query) | F.lower("external_id").contains(query) | F.exists("aliases", lambda a: F.lower(a).contains(query))
    rank = F.when(F.col("normalized_name") == query, 0).when(F.col("normalized_name").startswith(query), 1).otherwise(2)
    return (persons.filter(hit) if query else persons).withColumn("rank", rank).orderBy("rank", "normalized_name", "id").limit(catalog_limit(limit))


def find_person(persons: DataFrame, name: str) -> DataFrame:
    """At most one person of a normalized name, or one of whose aliases is it; names come first, then the smaller id."""
    named = F.col("normalized_name") == name
    hit = named | F.exists("aliases", lambda a: F.lower(a) == name)
    return persons.filter(hit).orderBy(F.desc(named), "id").limit(1)
