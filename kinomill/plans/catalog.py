"""Catalogue queries: snapshots, joins, searches, consolidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinomill.functions import text
from kinomill.operators import catalog
from kinomill.plans.registry import Registry, sql_normalized
from kinomill.sources import snapshots
from kinomill.tables import table

plan = Registry()
QUERIES, ORACLES = plan.queries, plan.oracles

TITLES = "(SELECT DISTINCT * FROM titles)"
AKAS = "(SELECT DISTINCT title_id, aka_no, title, area_code, lang, is_original_title FROM title_akas WHERE title IS NOT NULL)"
F9 = "(SELECT line_no, string_split(regexp_replace(line, '\\r$', ''), chr(9)) AS f FROM raw_title_basics)"
P6 = "(SELECT line_no, string_split(regexp_replace(line, '\\r$', ''), chr(9)) AS f FROM raw_title_principals)"
NUM = r"coalesce(CASE WHEN regexp_full_match({0}, '[+-]?[0-9]+') THEN greatest(TRY_CAST({0} AS INT), 0) END, 0)"
YEAR = r"CASE WHEN regexp_full_match({0}, '[+-]?[0-9]+') AND TRY_CAST({0} AS INT) > 0 THEN TRY_CAST({0} AS INT) END"


def _titles(spark, folder):
    rows = table(spark, folder, "titles").dropDuplicates(["title_id"])
    rows = rows.select("title_id", F.col("primary_title").alias("title"), "original_title", F.col("start_year").alias("year"), "title_type", "is_adult", "runtime_minutes", "average_rating", "vote_count")
    return rows.withColumns({"normalized_title": text.normalized(F.col("title")), "normalized_original_title": text.normalized(F.col("original_title"))})


def _alternates(spark, folder):
    rows = table(spark, folder, "title_akas").filter("title IS NOT NULL").select("title_id", F.col("aka_no").alias("ordering"), "title", F.col("area_code").alias("region"), F.col("lang").alias("language"))
    return rows.distinct()


def _cast(spark, folder):
    return snapshots.principals(table(spark, folder, "raw_title_principals"), ("actor", "actress", "self"))


NORM = f"(SELECT *, {sql_normalized('primary_title')} AS n, {sql_normalized('original_title')} AS o FROM {TITLES})"


@plan(f"SELECT line_no, f[1] AS title_id, len(f)::INT AS fields FROM {F9} WHERE len(f) >= 9 AND f[1] <> 'tconst'")
def tsv_scan_io02(spark, folder):
    rows = snapshots.fields(table(spark, folder, "raw_title_basics"), 9, "tconst")
    return rows.select("line_no", F.get("f", F.lit(0)).alias("title_id"), F.size("f").alias("fields"))


@plan(
    f"""SELECT line_no, replace(f[1], '\\N', '') AS title_id, {YEAR.format('f[6]')} AS year, {NUM.format('f[8]')} AS runtime_minutes FROM {F9}
        WHERE len(f) >= 9 AND f[1] <> 'tconst' AND f[2] = 'movie' AND f[5] <> '1' AND {YEAR.format('f[6]')} BETWEEN 1950 AND 2000 AND f[1] IN (SELECT title_id FROM titles WHERE runtime_minutes > 90)"""
)
def titles_scan_io03_p14_p15_p16_so02(spark, folder):
    allowed = table(spark, folder, "titles").filter("runtime_minutes > 90").select("title_id").distinct()
    rows = catalog.select_titles(snapshots.titles(table(spark, folder, "raw_title_basics")), allowed, include_adult=False, first_year=1950, last_year=2000)
    return rows.select("line_no", "title_id", "year", "runtime_minutes")


@plan(f"SELECT line_no, f[1] AS title_id FROM {F9} WHERE len(f) >= 9 AND f[1] <> 'tconst' AND f[2] = 'movie' ORDER BY line_no LIMIT 50")
def max_titles_sl16(spark, folder):
    return catalog.select_titles(snapshots.titles(table(spark, folder, "raw_title_basics")), most=50).select("line_no", "title_id")


@plan(f"SELECT title_id, round(coalesce(average_rating, 0)::FLOAT::DOUBLE, 4) AS average_rating, coalesce(vote_count, 0) AS vote_count FROM {TITLES}")
def ratings_join_io04_j03(spark, folder):
    rows = _titles(spark, folder)
    missing = F.lit("\\N")
    line = F.concat_ws("\t", "title_id", F.coalesce(F.round(F.col("average_rating").cast("double"), 4).cast("string"), missing), F.coalesce(F.col("vote_count").cast("string"), missing))
    lines = rows.select(F.lit(1).alias("line_no"), line.alias("line")).unionAll(spark.createDataFrame([(0, "tconst\taverageRating\tnumVotes")], "line_no int, line string"))
    rated = catalog.with_ratings(rows.select("title_id"), snapshots.ratings(lines))
    return rated.select("title_id", F.round(F.col("average_rating").cast("double"), 4).alias("average_rating"), "vote_count")


@plan(f"SELECT title_id, aka_no AS ordering, title, coalesce(area_code, '') AS region, coalesce(lang, '') AS language FROM (SELECT DISTINCT title_id, aka_no, title, area_code, lang FROM {AKAS}) WHERE title <> ''")
def alternates_scan_io05(spark, folder):
    rows = _alternates(spark, folder)
    line = F.concat_ws("\t", "title_id", F.col("ordering").cast("string"), "title", F.coalesce("region", F.lit("\\N")), F.coalesce("language", F.lit("\\N")))
    found = snapshots.alternates(rows.select(F.lit(0).alias("line_no"), line.alias("line")))
    return found.select("title_id", "ordering", "title", "region", "language")


@plan(f"SELECT title_id, len(genres)::INT AS directors, CASE WHEN len(genres) > 0 THEN genres[1] ELSE '' END AS first FROM {TITLES}")
def crew_join_io06_j04(spark, folder):
    rows = table(spark, folder, "titles").dropDuplicates(["title_id"])
    members = F.when(F.size("genres") > 0, F.array_join("genres", ",")).otherwise("\\N")
    lines = rows.select(F.lit(0).alias("line_no"), F.concat_ws("\t", "title_id", members, F.lit("\\N")).alias("line"))
    joined = rows.select("title_id").join(snapshots.crew(lines), "title_id", "left")
    return joined.select("title_id", F.size("directors").alias("directors"), F.coalesce(F.get("directors", F.lit(0)), F.lit("")).alias("first"))


@plan(rf"SELECT line_no, replace(f[1], '\N', '') AS title_id, replace(f[3], '\N', '') AS name_id, {NUM.format('f[2]')} AS ordering FROM {P6} WHERE len(f) >= 6 AND f[1] <> 'tconst' AND f[4] IN ('actor', 'actress')")
def principals_scan_io07(spark, folder):
    return snapshots.principals(table(spark, folder, "raw_title_principals")).select("line_no", "title_id", "name_id", "ordering")


@plan(rf"SELECT DISTINCT replace(f[3], '\N', '') AS name_id FROM {P6} WHERE len(f) >= 6 AND f[1] <> 'tconst' AND f[4] IN ('actor', 'actress')")
def names_scan_io08(spark, folder):
    everyone = snapshots.principals(table(spark, folder, "raw_title_principals"), ("actor", "actress", "self", "writer", "director")).select("name_id").distinct()
    line = F.concat_ws("\t", "name_id", F.concat(F.lit("Person "), "name_id"), F.lit("1980"), F.lit("\\N"), F.lit("actor"), F.lit("\\N"))
    people = snapshots.names(everyone.select(F.lit(0).alias("line_no"), line.alias("line")))
    wanted = snapshots.principals(table(spark, folder, "raw_title_principals")).select("name_id").distinct()
    return people.join(wanted, "name_id", "left_semi").select("name_id")


@plan("SELECT DISTINCT trim(list_extract(string_split(title_id || ' # ' || coalesce(primary_title, ''), '#'), 1)) AS title_id FROM titles")
def allow_list_io09(spark, folder):
    lines = table(spark, folder, "titles").select(F.concat("title_id", F.lit(" # "), F.coalesce("primary_title", F.lit(""))).alias("line"))
    return snapshots.allowed_ids(lines.unionAll(spark.createDataFrame([("# a comment",), ("",)], "line string")))


@plan(
    f"""SELECT title_id, count(DISTINCT a.title)::INT AS names, coalesce(min_by(a.title, (aka_no, a.title)), '') AS first FROM {TITLES} t LEFT JOIN {AKAS} a USING (title_id) GROUP BY title_id"""
)
def akas_nest_j05_ag08_m07(spark, folder):
    rows = catalog.with_alternates(_titles(spark, folder).select("title_id"), _alternates(spark, folder))
    return rows.select("title_id", F.size("alternate_titles").alias("names"), F.coalesce(F.get("alternate_titles", F.lit(0)), F.lit("")).alias("first"))


_CAST = rf"(SELECT line_no, replace(f[1], '\N', '') AS title_id, replace(f[3], '\N', '') AS name_id, {NUM.format('f[2]')} AS ordering FROM {P6} WHERE len(f) >= 6 AND f[1] <> 'tconst' AND f[4] IN ('actor', 'actress', 'self'))"


@plan(f"SELECT line_no, title_id, name_id, ordering FROM {_CAST} WHERE title_id IN (SELECT title_id FROM titles) AND name_id LIKE 'nm%' AND name_id NOT LIKE 'nm9%'")
def cast_join_j06_j16(spark, folder):
    cast = _cast(spark, folder)
    blank = F.when(F.col("name_id").startswith("nm9"), " ").otherwise(F.concat(F.lit("Person "), "name_id"))
    names = cast.filter("name_id LIKE 'nm%'").select("name_id", blank.alias("name")).distinct()
    return catalog.cast_of(_titles(spark, folder), cast, names).select("line_no", "title_id", "name_id", "ordering")


@plan(f"SELECT title_id, name_id, min(ordering) AS ordering FROM {_CAST} GROUP BY ALL")
def cast_people_j07_ag09_wf12(spark, folder):
    return catalog.people_of_cast(_cast(spark, folder)).select("title_id", "name_id", "ordering")


@plan(f"SELECT title_id, n AS normalized_title, CASE WHEN n = 'river' OR o = 'river' THEN 0 WHEN starts_with(n, 'river') OR starts_with(o, 'river') THEN 1 ELSE 2 END AS rank FROM {NORM} t WHERE contains(n, 'river') OR contains(o, 'river') OR EXISTS (SELECT 1 FROM {AKAS} a WHERE a.title_id = t.title_id AND contains(lower(a.title), 'river')) ORDER BY rank, n, start_year NULLS FIRST, title_id LIMIT 100")
def movie_search_sl05_sl06_j17_so01(spark, folder):
    return catalog.search_titles(_titles(spark, folder), "river", 100, _alternates(spark, folder)).select("title_id", "normalized_title", "rank")


@plan(f"SELECT title_id, n AS normalized_title, CASE WHEN n = 'goodbye' OR o = 'goodbye' THEN 0 WHEN starts_with(n, 'goodbye') OR starts_with(o, 'goodbye') THEN 1 ELSE 2 END AS rank FROM {NORM} t WHERE contains(n, 'goodbye') OR contains(o, 'goodbye') ORDER BY rank, n, start_year NULLS FIRST, title_id LIMIT 20")
def title_search_sl07_sl08(spark, folder):
    return catalog.search_titles(_titles(spark, folder), "goodbye", 20).select("title_id", "normalized_title", "rank")


@plan(
    f"""WITH w AS (SELECT title AS v FROM {AKAS} GROUP BY 1 ORDER BY count(DISTINCT title_id) DESC, 1 LIMIT 1),
        i AS (SELECT title_id FROM (SELECT t.title_id FROM {TITLES} t, w WHERE primary_title = v OR original_title = v UNION SELECT title_id FROM {AKAS}, w WHERE title = v) ORDER BY 1 LIMIT 3)
        SELECT title_id, coalesce(start_year, 0) AS year FROM {TITLES} JOIN i USING (title_id)"""
)
def exact_title_sl09_so01(spark, folder):
    """The name that most titles have, and the first three ids of it."""
    names = _alternates(spark, folder).groupBy("title").agg(F.countDistinct("title_id").alias("n"))
    wanted = names.orderBy(F.desc("n"), "title").first()["title"]
    found = catalog.titles_by_exact_name(_titles(spark, folder), _alternates(spark, folder), [wanted], 3)
    return found.select("title_id", F.coalesce("year", F.lit(0)).alias("year"))


@plan(f"WITH w AS (SELECT max(n) AS v FROM {NORM}) SELECT title_id, start_year AS year FROM {NORM} t, w WHERE n = v OR o = v OR title_id IN (SELECT title_id FROM {AKAS}, w WHERE lower(title) = v) ORDER BY start_year NULLS LAST, title_id LIMIT 1")
def find_movie_sl10_sl14(spark, folder):
    titles = _titles(spark, folder)
    wanted = titles.agg(F.max("normalized_title")).first()[0]
    return catalog.find_title(titles, _alternates(spark, folder), wanted).select("title_id", "year")


_PEOPLE = f"""(SELECT title_id AS id, n AS name, list(DISTINCT lower(a.title)) FILTER (a.title IS NOT NULL) AS aliases FROM {NORM} t LEFT JOIN {AKAS} a USING (title_id) GROUP BY ALL)"""


def _people(spark, folder):
    """Titles as if they were people: a name, an id, and other names as aliases."""
    rows = catalog.with_alternates(_titles(spark, folder).select("title_id", "normalized_title"), _alternates(spark, folder))
    return rows.select(F.col("title_id").alias("id"), F.col("normalized_title").alias("normalized_name"), F.col("title_id").alias("external_id"), F.col("alternate_titles").alias("aliases"))


@plan(
    f"""SELECT id, name, CASE WHEN name = 'ri' THEN 0 WHEN starts_with(name, 'ri') THEN 1 ELSE 2 END AS rank, contains(name, 'ri') AS by_name FROM {_PEOPLE}
        WHERE contains(name, 'ri') OR contains(id, 'ri') OR len(list_filter(aliases, lambda a: contains(a, 'ri'))) > 0 ORDER BY rank, name, id LIMIT 100"""
)
def person_search_sl11_sl12_j18_p23(spark, folder):
    """Some are found by an alias alone."""
    found = catalog.search_people(_people(spark, folder), "ri", 1000)
    return found.select("id", F.col("normalized_name").alias("name"), "rank", F.col("normalized_name").contains("ri").alias("by_name"))


@plan(f"WITH w AS (SELECT max(lower(title)) AS v FROM {AKAS}) SELECT id, name FROM {_PEOPLE}, w WHERE name = v OR list_contains(aliases, v) ORDER BY name = v DESC, id LIMIT 1")
def find_person_sl13(spark, folder):
    """One person by a name that may be an alias."""
    wanted = _alternates(spark, folder).agg(F.max(F.lower("title"))).first()[0]
    return catalog.find_person(_people(spark, folder), wanted).select("id", F.col("normalized_name").alias("name"))


@plan("SELECT person_id, count(DISTINCT vector_id) AS vectors FROM face_vectors WHERE person_id <> '' GROUP BY 1 HAVING count(DISTINCT vector_id) >= 3")
def vector_counts_ag04(spark, folder):
    vectors = table(spark, folder, "face_vectors").filter("person_id <> ''").select("person_id", "vector_id").distinct()
    return vectors.groupBy("person_id").agg(F.count("*").alias("vectors")).filter("vectors >= 3")


@plan(
    """WITH v AS (SELECT person_id FROM (SELECT DISTINCT person_id, vector_id FROM face_vectors WHERE person_id <> '') GROUP BY 1 HAVING count(*) >= 5)
       SELECT DISTINCT person_id FROM scene_people WHERE person_id IN (SELECT person_id FROM v) AND media_id IN (SELECT media_id FROM media WHERE release_year >= 1980)"""
)
def ready_for_titles_p21_p22(spark, folder):
    seen = table(spark, folder, "scene_people").select(F.col("media_id").alias("title_id"), "person_id").distinct()
    vectors = table(spark, folder, "face_vectors").filter("person_id <> ''").select("person_id", "vector_id").distinct()
    wanted = table(spark, folder, "media").filter("release_year >= 1980").select(F.col("media_id").alias("title_id"))
    return catalog.ready_people(seen.select("person_id").distinct(), vectors, 5, seen, wanted)


@plan(
    """WITH c AS (SELECT DISTINCT media_id AS title_id, person_id FROM scene_people WHERE person_id <> ''), v AS (SELECT person_id FROM (SELECT DISTINCT person_id, vector_id FROM face_vectors WHERE person_id <> '') GROUP BY 1 HAVING count(*) >= 5)
       SELECT title_id, count(*) AS people, count(v.person_id) AS ready, coalesce(string_agg(CASE WHEN v.person_id IS NULL THEN c.person_id END, ',' ORDER BY c.person_id), '') AS missing, CASE WHEN count(*) = count(v.person_id) THEN 'complete' ELSE 'partial' END AS status
       FROM c LEFT JOIN v ON c.person_id = v.person_id GROUP BY title_id"""
)
def face_bank_ag10(spark, folder):
    cast = table(spark, folder, "scene_people").select(F.col("media_id").alias("title_id"), "person_id").distinct()
    vectors = table(spark, folder, "face_vectors").filter("person_id <> ''").select("person_id", "vector_id").distinct()
    return catalog.bank_status(cast, vectors, 5).withColumn("missing", F.array_join("missing", ","))


_VALID = rf"""(SELECT f[1] AS title_id, max_by(f, line_no) AS f FROM {F9} WHERE len(f) = 9 AND regexp_full_match(f[1], 'tt[0-9]+') GROUP BY 1)"""


@plan(
    rf"""SELECT coalesce(v.title_id, t.title_id) AS title_id, coalesce(CASE WHEN trim(replace(v.f[3], '\N', '')) <> '' THEN replace(v.f[3], '\N', '') END, t.primary_title) AS title,
        coalesce({YEAR.format('v.f[6]')}, t.start_year) AS year, CASE WHEN v.title_id IS NOT NULL THEN {NUM.format('v.f[8]')} ELSE coalesce(t.runtime_minutes, 0) END AS runtime_minutes
        FROM {TITLES} t FULL JOIN {_VALID} v ON t.title_id = v.title_id"""
)
def merge_rows_m01_m02_m06_w06(spark, folder):
    lines = snapshots.fields(table(spark, folder, "raw_title_basics"), 9, "tconst").filter((F.size("f") == 9) & F.get("f", F.lit(0)).rlike("^tt[0-9]+$"))
    newest = lines.groupBy(F.get("f", F.lit(0)).alias("id")).agg(F.max_by("f", "line_no").alias("f"))
    incoming = snapshots.titles(newest.select(F.lit(0).alias("line_no"), F.array_join("f", "\t").alias("line"))).select("title_id", "title", "year", "runtime_minutes")
    existing = _titles(spark, folder).select("title_id", "title", "year", F.coalesce("runtime_minutes", F.lit(0)).alias("runtime_minutes"))
    return catalog.merge_rows(existing, incoming, "title_id", {"title": "text", "year": "given", "runtime_minutes": "always"})


@plan(
    """SELECT media_id, cardinality(m)::INT AS members, coalesce(m['a'], '') AS a, coalesce(m['b'], '') AS b FROM (SELECT media_id, map_concat(MAP {'a': 'old', 'b': 'old'}, CASE WHEN media_type = 'movie' THEN MAP {'b': 'new'} ELSE MAP {'c': 'new'} END) AS m
       FROM (SELECT media_id, max_by(media_type, updated_at) AS media_type FROM media GROUP BY 1))"""
)
def map_merge_ar03_ar11_ar12(spark, folder):
    rows = table(spark, folder, "media").groupBy("media_id").agg(F.max_by("media_type", "updated_at").alias("t"))
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old"))
    new = F.create_map(F.when(F.col("t") == "movie", "b").otherwise("c"), F.lit("new"))
    both = catalog.merge_maps(old, new)
    return rows.select("media_id", F.size(both).alias("members"), F.coalesce(F.try_element_at(both, F.lit("a")), F.lit("")).alias("a"), F.coalesce(F.try_element_at(both, F.lit("b")), F.lit("")).alias("b"))


@plan(
    f"""WITH m AS (SELECT DISTINCT media_id, {sql_normalized('title')} AS n FROM media WHERE title <> ''), s AS (SELECT n, min(title_id) AS canonical FROM {NORM} WHERE n <> '' GROUP BY n HAVING count(DISTINCT title_id) = 1)
        SELECT DISTINCT media_id AS id, canonical FROM m JOIN s USING (n)"""
)
def dup_repair_j24(spark, folder):
    bare = table(spark, folder, "media").filter("title <> ''").select(F.col("media_id").alias("id"), text.normalized(F.col("title")).alias("name")).distinct()
    known = _titles(spark, folder).select(F.col("title_id").alias("id"), F.col("normalized_title").alias("name"))
    return catalog.unique_by_name(bare, known, "name").distinct()


@plan(
    f"""WITH m AS (SELECT DISTINCT media_id, title, coalesce(original_title, '') AS original FROM media), t AS (SELECT primary_title AS v, min(title_id) AS a FROM {TITLES} WHERE primary_title <> '' GROUP BY 1), u AS (SELECT original_title AS v, min(title_id) AS b FROM {TITLES} WHERE original_title <> '' GROUP BY 1)
        SELECT media_id, coalesce(a, b, media_id) AS canonical FROM m LEFT JOIN t ON t.v = title LEFT JOIN u ON u.v = original"""
)
def prioritized_lookup_j23(spark, folder):
    rows = table(spark, folder, "media").select(F.col("media_id").alias("id"), "title", F.coalesce("original_title", F.lit("")).alias("original_title")).distinct()
    existing = _titles(spark, folder).select(F.col("title_id").alias("id"), "title", "original_title")
    return catalog.resolved_ids(rows, existing, ["title", "original_title"]).select(F.col("id").alias("media_id"), "canonical")


@plan(
    """WITH RECURSIVE e AS (SELECT DISTINCT vector_id AS id, person_id AS a, image_id AS b FROM face_vectors), u AS (SELECT id, 'a' || a AS k FROM e WHERE trim(a) <> '' UNION SELECT id, 'b' || b FROM e WHERE trim(b) <> ''),
       links AS (SELECT DISTINCT x.id AS i, y.id AS j FROM u x JOIN u y USING (k)), r AS (SELECT id AS i, id AS j FROM e UNION SELECT r.i, links.j FROM r JOIN links ON r.j = links.i) SELECT i AS id, min(j) AS canonical FROM r GROUP BY i"""
)
def identity_map_w07_w08(spark, folder):
    rows = table(spark, folder, "face_vectors").select(F.col("vector_id").alias("id"), "person_id", "image_id").distinct()
    return catalog.identity_map(rows, ["person_id", "image_id"])


@plan(
    f"""WITH first AS (SELECT title_id, min(name_id) AS canonical FROM {_CAST} WHERE title_id <> '' GROUP BY 1), c AS (SELECT DISTINCT title_id, name_id FROM {_CAST} WHERE title_id <> '')
        SELECT DISTINCT title_id, canonical AS name_id FROM c JOIN first USING (title_id)"""
)
def merge_duplicate_w08(spark, folder):
    """Every person of a title led to its smallest, and the rows made equal by that kept once."""
    cast = _cast(spark, folder).filter("title_id <> ''").select("title_id", "name_id").distinct()
    led = cast.withColumn("id", F.concat_ws("|", "title_id", "name_id"))
    ids = led.join(led.groupBy("title_id").agg(F.min("id").alias("canonical")), "title_id").select("id", "canonical")
    pointed = catalog.repoint(led.select("title_id", F.col("id").alias("person")), ids, "person", ["title_id", "person"])
    return pointed.select("title_id", F.split_part("person", F.lit("|"), F.lit(2)).alias("name_id"))


@plan(
    """WITH old AS (SELECT DISTINCT media_id, scene_id, person_id, best_score FROM scene_people WHERE best_score IS NOT NULL), p AS (SELECT DISTINCT media_id FROM media WHERE release_year < 1980)
       SELECT media_id, scene_id, person_id, 'old' AS source FROM (SELECT DISTINCT media_id, scene_id, person_id FROM old) WHERE media_id NOT IN (SELECT media_id FROM p)
       UNION ALL SELECT DISTINCT media_id, '', 'person:none', 'new' FROM p"""
)
def replace_children_w09_w12(spark, folder):
    old = table(spark, folder, "scene_people").filter("best_score IS NOT NULL").select("media_id", "scene_id", "person_id").distinct().withColumn("source", F.lit("old"))
    new = table(spark, folder, "media").filter("release_year < 1980").select("media_id", F.lit("").alias("scene_id"), F.lit("person:none").alias("person_id"), F.lit("new").alias("source"))
    return catalog.replace_children(old, new, ["media_id"], ["media_id", "scene_id", "person_id"])


@plan("SELECT title_id, max(runtime_minutes) AS minutes FROM titles GROUP BY 1 UNION ALL SELECT DISTINCT f[1], -1 FROM (SELECT string_split(line, chr(9)) AS f FROM raw_title_basics) WHERE len(f) >= 9 AND f[1] <> 'tconst' AND f[1] NOT IN (SELECT title_id FROM titles)")
def insert_missing_so04(spark, folder):
    old = table(spark, folder, "titles").groupBy("title_id").agg(F.max("runtime_minutes").alias("minutes"))
    lines = table(spark, folder, "raw_title_basics").select(F.split("line", "\t", -1).alias("f")).filter((F.size("f") >= 9) & (F.get("f", F.lit(0)) != "tconst"))
    return catalog.insert_missing(old, lines.select(F.get("f", F.lit(0)).alias("title_id"), F.lit(-1).alias("minutes")), ["title_id"])


@plan(
    """WITH ok AS (SELECT DISTINCT person_id FROM face_vectors WHERE person_id <> ''), s AS (SELECT DISTINCT media_id, scene_id, person_id FROM scene_people)
       SELECT 'scene_people' AS what, (SELECT count(*) FROM s) - (SELECT count(*) FROM s WHERE person_id IN (SELECT person_id FROM ok)) AS removed
       UNION ALL SELECT 'vectors', (SELECT count(DISTINCT vector_id) FROM face_vectors) - (SELECT count(DISTINCT vector_id) FROM face_vectors WHERE person_id IN (SELECT person_id FROM ok))"""
)
def authority_cleanup_w16(spark, folder):
    vectors = table(spark, folder, "face_vectors")
    people = vectors.filter("person_id <> ''").select("person_id").distinct()

    def removed(rows, name):
        kept = catalog.with_owner(rows, people, "person_id").withColumn("kept", F.lit(1)).select("kept").unionAll(rows.select(F.lit(0).alias("kept")))
        return kept.agg((F.count(F.when(F.col("kept") == 0, 1)) - F.count(F.when(F.col("kept") == 1, 1))).alias("removed")).select(F.lit(name).alias("what"), "removed")

    scenes = table(spark, folder, "scene_people").select("media_id", "scene_id", "person_id").distinct()
    return removed(scenes, "scene_people").unionAll(removed(vectors.select("vector_id", "person_id").dropDuplicates(["vector_id"]), "vectors"))


@plan("SELECT DISTINCT scene_id FROM scene_people WHERE scene_id NOT IN (SELECT scene_id FROM scene_results)")
def orphan_cleanup_j16_so03(spark, folder):
    return catalog.without_owner(table(spark, folder, "scene_people").select("scene_id").distinct(), table(spark, folder, "scene_results"), "scene_id")


@plan(f"SELECT normalized_name, min_by(name, ord) AS name FROM (SELECT {sql_normalized('title')} AS normalized_name, title AS name, title_id || ':' || lpad(aka_no::VARCHAR, 4, '0') AS ord FROM {AKAS}) GROUP BY 1")
def unique_names_ag18(spark, folder):
    rows = _alternates(spark, folder).select(text.normalized(F.col("title")).alias("normalized_name"), F.col("title").alias("name"), F.concat("title_id", F.lit(":"), F.lpad(F.col("ordering").cast("string"), 4, "0")).alias("ord"))
    return rows.groupBy("normalized_name").agg(F.min_by("name", "ord").alias("name"))
