import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kinomill.operators.rejects import TITLE_BASICS, TITLE_PRINCIPALS, is_strict_json, json_names_reason, load_lines, reject_lines

GOOD = "tt1\tmovie\tA\tA\t0\t1999\t\\N\t90\tDrama,War"
CAST = "tt1\t1\tnm1\tactor\t\\N\t"


def rejects(spark, lines, spec, schema="line_no bigint, line string"):
    return {r["line_no"]: r["reason"] for r in reject_lines(spark.createDataFrame(lines, schema), spec).collect()}


def test_reasons_of_titles(spark):
    lines = [
        (1, "tconst\tx"),
        (2, GOOD),
        (3, GOOD + "\r"),
        (4, GOOD + "\t"),
        (5, None),
        (6, ""),
        (7, GOOD.replace("1999", "1887")),
        (8, GOOD.replace("1999", "２０００")),
        (9, GOOD.replace("\t90\t", "\t123456\t")),
        (10, GOOD.replace("tt1", "tt1\n")),
        (11, GOOD.replace("\t0\t", "\ttrue\t")),
        (12, GOOD.replace("1999", "2101")),
        (13, GOOD.replace("Drama", "Dra\u200bma" * 50_000)),
    ]
    assert rejects(spark, lines, TITLE_BASICS) == {
        4: "column_count", 5: "column_count", 6: "column_count", 7: "invalid_value", 8: "invalid_value", 9: "invalid_value", 10: "invalid_value", 11: "invalid_value", 12: "invalid_value",
    }


def test_reasons_of_principals(spark):
    cases = {
        '["A"]': None, "\\N": None, '["A\\"B", "C"]': None, '["\\u00e9"]': None, "[]": "invalid_value", '["A", " "]': "invalid_value", '["A", null]': "invalid_value", '{"a": 1}': "invalid_value", '"A"': "invalid_value",
        "1": "invalid_value", "[1]": "invalid_value", "['A']": "broken_quoting", '["A"': "broken_quoting", '["A"]]': "broken_quoting", "[A]": "broken_quoting", "": "broken_quoting", "NaN": "broken_quoting",
        "[NaN]": "broken_quoting", '["A",]': "broken_quoting", '["a\x01"]': "broken_quoting", "[01]": "broken_quoting", "[1.5e3]": "invalid_value", "“A”": "broken_quoting",
    }
    lines = [(i, CAST + value) for i, value in enumerate(cases)]
    expected = {i: reason for i, reason in enumerate(cases.values()) if reason}
    assert rejects(spark, lines, TITLE_PRINCIPALS) == expected


def test_first_reason_and_repeated_lines(spark):
    bad = "tx1\t1\tnm1\tactor\t\\N\t[A]"
    assert rejects(spark, [(1, bad), (1, bad), (2, bad + "\tmore")], TITLE_PRINCIPALS) == {1: "broken_quoting", 2: "column_count"}


def test_valid_lines_come_out_typed_once(spark):
    df = spark.createDataFrame([(1, GOOD, "x"), (1, GOOD, "x"), (2, "no", "y")], "line_no bigint, line string, title_id string")
    typed, bad = load_lines(df, TITLE_BASICS)
    rows = typed.collect()
    assert [(r["title_id"], r["is_adult"], r["start_year"], r["end_year"], r["runtime_minutes"], r["genres"]) for r in rows] == [("tt1", False, 1999, None, 90, ["Drama", "War"])]
    assert bad.count() == 1


def test_empty_table(spark):
    typed, bad = load_lines(spark.createDataFrame([], "line_no bigint, line string"), TITLE_PRINCIPALS)
    assert typed.count() == bad.count() == 0
    assert typed.columns[0] == "line_no" and bad.columns == ["line_no", "reason"]


def test_many_equal_values_are_spread(spark):
    lines = [(i, GOOD.replace("1999", "x" if i % 3 == 0 else "1999")) for i in range(3000)]
    assert len(rejects(spark, lines, TITLE_BASICS)) == 1000


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(json_values, st.integers(0, 100))
def test_strict_json_agrees_with_the_writer(value, cut):
    text = json.dumps(value)
    assert is_strict_json(text)
    if text[0] in '[{"' and len(text) > 1:
        assert not is_strict_json(text[: 1 + cut % (len(text) - 1)])


def test_deep_nesting_is_decided():
    deep = "[" * 200_000 + "]" * 200_000
    assert is_strict_json("[" * 3000 + "]" * 3000)
    assert json_names_reason("[" * 3000 + "]" * 2999) == "broken_quoting"
    assert len(deep) == 400_000


def test_random_lines_against_a_plain_restatement(spark):
    rng = random.Random(1)
    years = ["1999", "\\N", "1888", "2100", "1887", "99", "19999", " 1999", "x", ""]
    lines, expected = [], {}
    for i in range(300):
        y, e, m, a, t = (rng.choice(x) for x in (years, years, ["90", "\\N", "0", "99999", "100000", "9.5", ""], ["0", "1", "2", ""], ["tt1", "tt", "xx1", "tt１"]))
        lines.append((i, "\t".join([t, "movie", "A", "A", a, y, e, m, "X"])))
        good_year = lambda v: v == "\\N" or (len(v) == 4 and v.isascii() and v.isdigit() and 1888 <= int(v) <= 2100)
        if not (t == "tt1" and a in "01" and a and good_year(y) and good_year(e) and (m == "\\N" or (m.isdigit() and len(m) <= 5))):
            expected[i] = "invalid_value"
    assert rejects(spark, lines, TITLE_BASICS) == expected
