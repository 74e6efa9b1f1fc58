import pytest

from kinomill.operators import identity


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_upserts_go_to_the_first_matching_id_and_blank_values_do_not_count(spark):
    schema = "id string, imdb_id string, tmdb_id int, title string, year int, tags array<string>"
    known = rows(spark, [("a", "tt1", 0, "One", 1990, ["x"]), ("b", "", 7, "Two", None, None)], schema)
    new = [("n1", "tt1", 7, "Uno", None, ["x", "y"]), ("n2", None, 7, " ", 2000, None), ("n3", "", 7, "Dos", 2001, ["z"]), ("n4", "tt9", 9, "Tres", None, []), ("", "tt1", 7, "x", 1, None), ("b", "tt1", 0, "Duo", None, ["w"])]
    got = {r["id"]: (r["title"], r["year"], r["tags"]) for r in identity.upsert_by_ids(known, rows(spark, new, schema), ["id", "imdb_id", "tmdb_id"], {"title": "text", "year": "given", "tags": "union"}).collect()}
    # "b" by id comes before "n3" by TMDB id, whose values are the last
    assert got == {"a": ("Uno", 1990, ["x", "y"]), "b": ("Dos", 2001, ["w", "z"]), "n4": ("Tres", None, [])}


def test_consolidation_keeps_the_first_values_and_leads_children(spark):
    people = rows(spark, [("p1", "i1", None, " ", 1950), ("p2", "i1", "t2", "Ada", None), ("p3", None, "t2", "Bo", 1970), ("p4", " ", "0", "Cy", None)], "id string, imdb string, tmdb string, name string, year int")
    cast = rows(spark, [("m", "p1"), ("m", "p3"), ("n", "p3"), ("n", "p4")], "title string, person string")
    merged, children, ids = identity.consolidate(people, ["imdb", "tmdb"], ["name", "year"], {"cast": (cast, "person", ["title", "person"])})
    assert {(r["id"], r["name"], r["year"]) for r in merged.collect()} == {("p1", "Ada", 1950), ("p4", "Cy", None)}
    assert {tuple(r) for r in children["cast"].collect()} == {("m", "p1"), ("n", "p1"), ("n", "p4")}
    assert ids.filter("id <> canonical").count() == 2


def test_namesakes_with_several_ids_stay_apart(spark):
    people = rows(spark, [("x1", "e1", "ann lee"), ("x2", "e2", "bob ray"), ("x3", "e3", "bob ray"), ("l1", "", "ann lee"), ("l2", None, "bob ray"), ("l3", "", "none")], "id string, external_id string, name string")
    vectors = rows(spark, [("v1", "l1"), ("v2", "x1"), ("v3", "l2")], "vector string, person string")
    left, led = identity.repair_duplicates(people, "external_id", "name", {"v": (vectors, "person", ["vector"])})
    assert {r["id"] for r in left.collect()} == {"x1", "x2", "x3", "l2", "l3"}
    assert {tuple(r) for r in led["v"].collect()} == {("v1", "x1"), ("v2", "x1"), ("v3", "l2")}


def test_an_import_with_a_nameless_row_is_refused_before_anything_is_built(spark):
    titles = rows(spark, [("t1", " ")], "title_id string, title string")
    people = rows(spark, [], "id string, external_id string, name string")
    with pytest.raises(ValueError):
        identity.import_catalogue(titles, titles, rows(spark, [], "title_id string, person_id string, place int"), people, {})


def test_tiers_of_people_with_empty_tables(spark):
    asked = rows(spark, [("1", "t", "NM5", 0, "a"), ("2", "t", None, 8, "b"), ("3", "t", None, None, "c"), ("4", "u", None, None, "c")], "id string, title_id string, imdb_id string, tmdb_id int, name string")
    schema = "id string, imdb_id string, tmdb_id int, name string"
    people = rows(spark, [("p5", "nm5 ", 0, "x"), ("p8", "nm8", 8, "y"), ("p9", "nm9", 0, "c"), ("q9", "", 0, "c"), ("r9", "nm10", 0, "c")], schema)
    cast = rows(spark, [("t", "p9"), ("t", "q9"), ("u", "p9"), ("u", "r9")], "title_id string, person_id string")
    assert {(r["id"], r["canonical"], r["tier"]) for r in identity.canonical_people(asked, people, cast).collect()} == {("1", "p5", 1), ("2", "p8", 2), ("3", "p9", 3)}
    assert identity.canonical_people(asked, people.limit(0), cast).count() == 0
    assert {(r["id"], r["canonical"]) for r in identity.person_ids(rows(spark, [("person:tmdb:8",), ("person:tmdb:77",), ("person:tmdb:99999999999999",), ("p5",)], "id string"), people).collect()} == {
        ("person:tmdb:8", "p8"), ("person:tmdb:77", "person:tmdb:77"), ("person:tmdb:99999999999999", "person:tmdb:99999999999999"), ("p5", "p5"),
    }


@pytest.mark.parametrize(("name", "wanted"), [("person_tiers_j11", {("tt1", 2, "nm2", 3), ("tt1", 10, "nm10", 1)}), ("image_owners_j12", {(2, "nm2")})])
def test_ids_that_are_no_numbers_stop_no_query(spark, tmp_path, name, wanted):
    import __spark_entry__

    ids = ["nm2", "nm10", "nm3", "", "nm", "nm6805695x", r"\N", "6805695"]
    lines = [(n, f"tt1\t{n}\t{i}\tactor\t\\N\t\\N") for n, i in enumerate(ids)]
    rows(spark, lines, "line_no bigint, line string").write.parquet(f"{tmp_path}/raw_title_principals.parquet")
    assert {tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()} == wanted


def test_owners_of_images_are_found_with_the_lines_read_once(spark, tmp_path):
    import __spark_entry__

    cast = {"tt1": ["nm2", "nm6", "nm217", "nm212", "nm2", "nm", "nm6x", r"\N"], "tt2": ["nm12", "nm424", "nm7", "", "6"]}
    lines = [(n, f"{title}\t{n}\t{i}\tactor\t\\N\t\\N") for title, ids in cast.items() for n, i in enumerate(ids)]
    rows(spark, lines, "line_no bigint, line string").write.parquet(f"{tmp_path}/raw_title_principals.parquet")
    got = __spark_entry__.queries()["image_owners_j12"](spark, str(tmp_path))
    # 2 and 212 by name, 6 and 12 by TMDB id; 217 and 424 are later rows of images 6 and 2, 7 matches nobody
    assert {tuple(r) for r in got.collect()} == {(2, "nm2"), (1, "nm212"), (6, "nm6"), (12, "nm12")}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 1


def test_owners_of_images_of_an_empty_table(spark, tmp_path):
    import __spark_entry__

    rows(spark, [], "line_no bigint, line string").write.parquet(f"{tmp_path}/raw_title_principals.parquet")
    assert __spark_entry__.queries()["image_owners_j12"](spark, str(tmp_path)).collect() == []
