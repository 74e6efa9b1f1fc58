"""Queries that bring rows together under one id: closures, upserts, imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinomill.lineage import cut
from kinomill.operators import catalog, identity
from kinomill.plans.catalog import _CAST, _cast
from kinomill.plans.registry import Registry
from kinomill.tables import table

plan = Registry()
QUERIES, ORACLES = plan.queries, plan.oracles

#: Requests in chains: neighbours share one of two keys in turn, and a chain ends where both are absent. Values and children hang on some.
CHAIN = """(SELECT DISTINCT request_id AS id, CASE WHEN request_id % 7 <> 0 THEN (request_id // 2)::VARCHAR END AS imdb, CASE WHEN request_id % 5 <> 0 THEN ((request_id + 1) // 2)::VARCHAR ELSE ' ' END AS tmdb,
    CASE WHEN request_id % 3 = 0 THEN ' ' ELSE 'n' || request_id END AS name, CASE WHEN request_id % 4 = 0 THEN batch_no END AS year FROM requests)"""
REACHED = f"""e AS (SELECT * FROM {CHAIN}), links AS (SELECT x.id AS i, y.id AS j FROM e x JOIN e y ON x.imdb = y.imdb OR (x.tmdb = y.tmdb AND x.tmdb <> ' ')),
    r AS (SELECT id AS i, id AS j FROM e UNION SELECT r.i, links.j FROM r JOIN links ON r.j = links.i), ids AS (SELECT i AS id, min(j) AS canonical FROM r GROUP BY i)"""


def _chain(spark, folder):
    n = F.col("request_id")
    return table(spark, folder, "requests").select(
        n.alias("id"),
        F.when(n % 7 != 0, F.floor(n / 2).cast("string")).alias("imdb"),
        F.when(n % 5 != 0, F.floor((n + 1) / 2).cast("string")).otherwise(" ").alias("tmdb"),
        F.when(n % 3 == 0, " ").otherwise(F.concat(F.lit("n"), n.cast("string"))).alias("name"),
        F.when(n % 4 == 0, F.col("batch_no")).alias("year"),
    ).distinct()


@plan(f"WITH RECURSIVE {REACHED} SELECT id, canonical FROM ids")
def identity_closure_w07(spark, folder):
    """Rows led to the smallest id over chains of two keys, up to the fixed point."""
    return catalog.identity_map(_chain(spark, folder), ["imdb", "tmdb"])


@plan(
    f"""WITH RECURSIVE {REACHED}, m AS (SELECT canonical AS id, arg_min(name, e.id) FILTER (name <> ' ') AS name, arg_min(year, e.id) FILTER (year IS NOT NULL) AS year, count(*) AS merged FROM e JOIN ids USING (id) GROUP BY 1),
        c AS (SELECT canonical AS id, count(DISTINCT q.id % 3) AS children FROM ids q GROUP BY 1)
        SELECT id, name, year, merged, children FROM m JOIN c USING (id)"""
)
def consolidated_people_w07_w08_m01(spark, folder):
    """People merged by two keys with what they have, and their children led to them; children made equal are kept once."""
    rows = _chain(spark, folder)
    children = rows.select((F.col("id") % 3).alias("place"), F.col("id").alias("person"))
    merged, led, ids = identity.consolidate(rows, ["imdb", "tmdb"], ["name", "year"], {"cast": (children, "person", ["person", "place"])})
    sizes = ids.groupBy(F.col("canonical").alias("id")).agg(F.count("*").alias("merged"))
    held = led["cast"].groupBy(F.col("person").alias("id")).agg(F.count("*").alias("children"))
    return merged.join(sizes, "id").join(held, "id").select("id", "name", "year", "merged", "children")


_KNOWN = "(SELECT title_id AS id, title_id AS imdb_id, substr(title_id, 3)::BIGINT AS tmdb_id, min(primary_title) AS title, min(start_year) AS year, min(runtime_minutes) AS minutes FROM titles GROUP BY title_id)"


def _known(spark, folder):
    rows = table(spark, folder, "titles").groupBy(F.col("title_id").alias("id")).agg(F.min("primary_title").alias("title"), F.min("start_year").alias("year"), F.min("runtime_minutes").alias("minutes"))
    return rows.withColumns({"imdb_id": F.col("id"), "tmdb_id": F.expr("substr(id, 3)").cast("bigint"), "tags": F.array(F.lit("old"), F.lit("both"))})


@plan(
    f"""WITH k AS (SELECT *, tmdb_id % 5 AS kind FROM {_KNOWN}),
        n AS (SELECT id, CASE WHEN kind = 3 THEN 'new-' || id ELSE id END AS to_id, CASE WHEN tmdb_id % 2 = 0 THEN upper(title) ELSE ' ' END AS title, CASE WHEN tmdb_id % 3 = 0 THEN 1900 END AS year, tmdb_id % 4 * 10 AS minutes FROM k WHERE kind <> 4 AND (tmdb_id % 2 = 0 AND trim(coalesce(title, '')) <> ''))
        SELECT k.id, coalesce(CASE WHEN trim(n.title) <> '' THEN n.title END, k.title) AS title, coalesce(n.year, k.year) AS year, coalesce(CASE WHEN n.minutes > 0 THEN n.minutes END, k.minutes)::BIGINT AS minutes,
          CASE WHEN n.id IS NULL THEN 'old,both' ELSE 'old,both,new' END AS tags FROM k LEFT JOIN n ON n.to_id = k.id
        UNION ALL SELECT to_id, title, year, CASE WHEN minutes > 0 THEN minutes END::BIGINT, 'both,new' FROM n WHERE to_id <> id"""
)
def upsert_titles_w06_m01_m02(spark, folder):
    """Titles that come again under their id, an IMDb id or a TMDB id, new ones, and ones without a name."""
    known = _known(spark, folder)
    kind, own = F.col("tmdb_id") % 5, F.concat(F.lit("new-"), "id")
    incoming = known.filter(kind != 4).select(
        F.when(kind == 0, F.col("id")).otherwise(own).alias("id"),
        F.when(kind == 1, F.col("imdb_id")).alias("imdb_id"),
        F.when(kind == 2, F.col("tmdb_id")).alias("tmdb_id"),
        F.when(F.col("tmdb_id") % 2 == 0, F.upper("title")).otherwise(" ").alias("title"),
        F.when(F.col("tmdb_id") % 3 == 0, 1900).alias("year"),
        (F.col("tmdb_id") % 4 * 10).alias("minutes"),
        F.array(F.lit("both"), F.lit("new")).alias("tags"),
    )
    merged = identity.upsert_by_ids(known, incoming, ["id", "imdb_id", "tmdb_id"], {"title": "text", "year": "given", "minutes": "positive", "tags": "union"})
    return merged.select("id", "title", "year", F.col("minutes").cast("bigint").alias("minutes"), F.array_join("tags", ",").alias("tags"))


_PERSONS = f"""(SELECT name_id AS id, CASE WHEN n % 2 = 0 THEN ' ' || name_id ELSE '' END AS imdb_id, CASE WHEN n % 3 = 0 THEN n ELSE 0 END AS tmdb_id, 'person ' || n % 40 AS name, n FROM (SELECT DISTINCT name_id, substr(name_id, 3)::BIGINT AS n FROM {_CAST} WHERE regexp_full_match(name_id, 'nm[0-9]+')))"""


def _persons(spark, folder, cast=None):
    n = F.expr("substr(name_id, 3)").try_cast("bigint")  # conditions on it can be evaluated before the filter
    rows = (_cast(spark, folder) if cast is None else cast).filter(F.col("name_id").rlike(r"\Anm[0-9]+\z")).select(F.col("name_id").alias("id"), n.alias("n")).distinct()
    imdb = F.when(F.col("n") % 2 == 0, F.concat(F.lit(" "), "id")).otherwise("")
    return rows.withColumns({"imdb_id": imdb, "tmdb_id": F.when(F.col("n") % 3 == 0, F.col("n")).otherwise(0), "name": F.concat(F.lit("person "), (F.col("n") % 40).cast("string"))})


_ASKED = f"""(SELECT DISTINCT c.title_id, p.n, CASE WHEN n % 5 = 0 THEN upper(p.id) END AS imdb_id, CASE WHEN n % 5 IN (1, 2) THEN n END AS tmdb_id, p.name FROM {_CAST} c JOIN {_PERSONS} p ON p.id = c.name_id)"""
_TIERS = f"""k AS (SELECT * FROM {_PERSONS} WHERE trim(imdb_id) <> ''), b AS (SELECT title_id, name, min(id) AS id FROM (SELECT DISTINCT c.title_id, k.name, k.id FROM {_CAST} c JOIN k ON k.id = c.name_id) GROUP BY ALL HAVING count(DISTINCT id) = 1),
    t AS (SELECT a.*, i.id AS one, m.id AS two, b.id AS three FROM {_ASKED} a LEFT JOIN k i ON lower(trim(i.imdb_id)) = lower(a.imdb_id) LEFT JOIN k m ON m.tmdb_id = a.tmdb_id AND m.tmdb_id > 0 LEFT JOIN b ON b.title_id = a.title_id AND b.name = a.name)"""


def _asked(spark, folder, cast=None):
    people = _persons(spark, folder, cast)
    rows = (_cast(spark, folder) if cast is None else cast).select("title_id", F.col("name_id").alias("id")).distinct().join(people, "id")
    return rows.select("title_id", "id", "n", F.when(F.col("n") % 5 == 0, F.upper("id")).alias("imdb_id"), F.when((F.col("n") % 5).isin(1, 2), F.col("n")).alias("tmdb_id"), "name")


def _matched(spark, folder, cast=None):
    members = (_cast(spark, folder) if cast is None else cast).select("title_id", F.col("name_id").alias("person_id"))
    return identity.canonical_people(_asked(spark, folder, cast), _persons(spark, folder, cast), members)


@plan(f"WITH {_TIERS} SELECT title_id, n, coalesce(one, two, three) AS canonical, CASE WHEN one IS NOT NULL THEN 1 WHEN two IS NOT NULL THEN 2 ELSE 3 END AS tier FROM t WHERE coalesce(one, two, three) IS NOT NULL")
def person_tiers_j11(spark, folder):
    """People led to those of the catalogue by IMDb id, TMDB id, or a name that is unique in the cast of the title."""
    return _matched(spark, folder).select("title_id", "n", "canonical", "tier")


@plan(f"WITH {_TIERS}, o AS (SELECT tmdb_id, min(coalesce(one, two, three)) AS person_id FROM t WHERE tmdb_id > 0 AND coalesce(one, two, three) IS NOT NULL GROUP BY 1), i AS (SELECT n % 211 AS image_id, min(n) AS tmdb_id FROM {_PERSONS} GROUP BY 1) SELECT image_id, person_id FROM i JOIN o USING (tmdb_id)")
def image_owners_j12(spark, folder):
    """Images led to people by the TMDB id of their first row."""
    cast = cut(_cast(spark, folder).select("title_id", "name_id").distinct())  # lines are taken apart once, not for each of its seven uses
    images = _persons(spark, folder, cast).select((F.col("n") % 211).alias("image_id"), F.col("n").alias("tmdb_id"), F.col("n").alias("place"))
    return identity.canonical_images(images, _matched(spark, folder, cast)).select("image_id", "person_id")


@plan(f"WITH a AS (SELECT CASE n % 3 WHEN 0 THEN 'person:tmdb:' || n WHEN 1 THEN id ELSE 'person:tmdb:' || n || 'x' END AS id FROM {_PERSONS}) SELECT a.id, coalesce(p.id, q.id, a.id) AS canonical FROM a LEFT JOIN {_PERSONS} p ON p.id = a.id LEFT JOIN {_PERSONS} q ON q.tmdb_id > 0 AND a.id = 'person:tmdb:' || q.tmdb_id")
def person_ids_j25(spark, folder):
    people = _persons(spark, folder)
    number = F.concat(F.lit("person:tmdb:"), F.col("n").cast("string"))
    asked = people.select(F.when(F.col("n") % 3 == 0, number).when(F.col("n") % 3 == 1, F.col("id")).otherwise(F.concat(number, F.lit("x"))).alias("id"))
    return identity.person_ids(asked, people)


_IMPORT = f"""p AS (SELECT id, n, CASE WHEN n % 4 = 0 THEN '' ELSE id END AS ext, 'p' || n // 2 AS name FROM {_PERSONS}), d AS (SELECT name, min(id) AS to_id FROM p WHERE ext <> '' GROUP BY 1 HAVING count(*) = 1),
    g AS (SELECT p.id, d.to_id FROM p JOIN d USING (name) WHERE ext = ''), c AS (SELECT DISTINCT title_id, name_id AS id, ordering AS place FROM {_CAST}),
    l AS (SELECT DISTINCT title_id, coalesce(to_id, c.id) AS id, place FROM c LEFT JOIN g USING (id)), w AS (SELECT * FROM l WHERE title_id IN (SELECT title_id FROM titles) AND id IN (SELECT id FROM p))"""


def _imported(spark, folder):
    titles = table(spark, folder, "titles").groupBy("title_id").agg(F.min("primary_title").alias("title")).filter("trim(title) <> ''")
    people = _persons(spark, folder).select("id", F.when(F.col("n") % 4 == 0, "").otherwise(F.col("id")).alias("external_id"), F.concat(F.lit("p"), F.floor(F.col("n") / 2).cast("string")).alias("name"))
    cast = _cast(spark, folder).select("title_id", F.col("name_id").alias("person_id"), F.col("ordering").alias("place"))
    alternates = table(spark, folder, "title_akas").filter("title IS NOT NULL").select("title_id", "title").distinct()
    old_title = F.expr("substr(title_id, 3)").cast("bigint") % 3 == 0
    stored = {
        "titles": titles.filter(old_title).select("title_id", F.lit("old").alias("title")),
        "alternates": titles.filter(old_title).select("title_id", F.lit("old name").alias("title")),
        "people": people.limit(0),
        "cast": cast.filter("place = 1").distinct(),
    }
    return identity.import_catalogue(titles, alternates, cast, people, stored)


@plan(
    f"""WITH {_IMPORT}, ok AS (SELECT DISTINCT title_id FROM titles WHERE trim(primary_title) <> '') SELECT 'titles' AS counter, (SELECT count(*) FROM ok) AS n UNION ALL SELECT 'people', (SELECT count(*) FROM p)
        UNION ALL SELECT 'alternates', (SELECT count(*) FROM (SELECT DISTINCT title_id, title FROM title_akas WHERE title IS NOT NULL) SEMI JOIN ok USING (title_id)) UNION ALL SELECT 'cast_added', (SELECT count(*) FROM c WHERE place <> 1)
        UNION ALL SELECT 'people_merged', (SELECT count(*) FROM g) UNION ALL SELECT 'cast_kept', (SELECT count(*) FROM w SEMI JOIN ok USING (title_id))"""
)
def import_counters_ag11_w13(spark, folder):
    """Counters of a whole import into a catalogue that holds a part of it."""
    return _imported(spark, folder)[1]


@plan(f"WITH {_IMPORT}, ok AS (SELECT DISTINCT title_id FROM titles WHERE trim(primary_title) <> '') SELECT title_id, id AS person_id, place FROM w SEMI JOIN ok USING (title_id)")
def imported_cast_w13_w14(spark, folder):
    """Cast after the import: people without external id led to their namesakes, orphans gone."""
    return _imported(spark, folder)[0]["cast"].select("title_id", "person_id", "place")


@plan("SELECT media_id AS id, arg_max(title, (updated_at, title)) AS title FROM media WHERE title IS NOT NULL GROUP BY 1 UNION ALL SELECT DISTINCT title_id, 'old' FROM titles")
def last_written_x02(spark, folder):
    """Overwriting by id alone: rows of equal titles under other ids stay apart."""
    existing = table(spark, folder, "titles").select(F.col("title_id").alias("id"), F.lit("old").alias("title"), F.lit(None).cast("timestamp").alias("at")).distinct()
    old = table(spark, folder, "media").select(F.col("media_id").alias("id"), F.lit("older").alias("title"), F.lit(None).cast("timestamp").alias("at")).distinct()
    incoming = table(spark, folder, "media").filter("title IS NOT NULL").select(F.col("media_id").alias("id"), "title", F.col("updated_at").cast("timestamp").alias("at"))
    known = old.join(incoming.select("id").distinct(), "id", "left_semi")
    return identity.last_written(existing.unionByName(known), incoming, "id", ["at", "title"]).select("id", "title")


@plan("SELECT DISTINCT title_id, start_year FROM titles WHERE lower(title_id) = (SELECT lower(max(title_id)) FROM titles)")
def title_by_id_x01_x03(spark, folder):
    titles = table(spark, folder, "titles").select("title_id", "start_year").distinct()
    wanted = titles.agg(F.max("title_id")).first()[0]
    return identity.by_folded_id(titles, "title_id", f" {wanted.upper()}\t" if wanted else "")
