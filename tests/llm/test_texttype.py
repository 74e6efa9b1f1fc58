import random

import numpy as np

from kinomill.llm.texttype import LIST, PROSE, TABLE, TYPES, classify, learn, posterior, statistics, votes

RNG = random.Random(4)
NOUNS = ["garden", "bridge", "river", "letter", "lantern", "orchard", "mirror", "station"]
NAMES = ["Tavor", "Milesk", "Perun", "Zadik", "Horin"]


def prose():
    return " ".join(f"{RNG.choice(NAMES)} returns to the {RNG.choice(NOUNS)} because {RNG.choice(NAMES)} has lost a {RNG.choice(NOUNS)} in the rain." for _ in range(RNG.randint(1, 8)))


def listing():
    return "\n".join(f"{RNG.choice('-*')} {RNG.choice(NOUNS)} {RNG.choice(NAMES)}" for _ in range(RNG.randint(4, 15)))


def sheet():
    return "\n".join(f"{RNG.choice(NAMES)}\t{RNG.randint(1900, 2020)}\t{RNG.randint(60, 190)}\t{RNG.randint(10, 99999)}" for _ in range(RNG.randint(4, 15)))


def junk():
    return RNG.choice(["".join(RNG.choice("{}[]<>#$%^&*_|\\~@ab19") for _ in range(200)), "stream watch film hd " * 20, "\n".join(f"2024-01-0{RNG.randint(1, 9)}T10:00:00Z INFO task={RNG.randint(1, 999)}" for _ in range(9))])


def corpus():
    makers = {"prose": prose, "list": listing, "table": sheet, "junk": junk}
    return [(i, makers[kind](), kind) for i, kind in enumerate([RNG.choice(["prose"] * 7 + ["list", "table", "junk"]) for _ in range(400)])]


def test_types_of_a_made_corpus(spark):
    rows = corpus()
    got = {r["doc_id"]: r["type"] for r in classify(spark.createDataFrame(rows, "doc_id int, text string, type string")).collect()}
    right = [(got[i] == PROSE) == (kind == PROSE) for i, _, kind in rows]
    assert np.mean(right) > 0.99
    assert np.mean([got[i] == kind for i, _, kind in rows if kind in (LIST, TABLE)]) > 0.9


def test_blank_texts_repeated_rows_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n ​"), (4, prose()), (5, "x" * 300_000), (6, prose() * 2000)]
    rows += [(4, rows[3][1])]
    out = classify(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == [4, 5, 6]


def test_empty_table_and_clashing_columns(spark):
    assert classify(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    df = spark.createDataFrame([(1, prose(), 5, "x")], "doc_id bigint, text string, code int, lines string")
    assert classify(df).columns == ["doc_id", "type", "confidence"]


def test_statistics(spark):
    row = statistics(spark.createDataFrame([(1, "The cat sat. It purred!\n- item")], "doc_id int, text string")).first()
    assert row["word_count"] == 6 and row["line_count"] == 2
    assert row["ended_lines"] == 0.5 and row["bulleted_lines"] == 0.5
    assert round(row["common_words"], 3) == round(2 / 6, 3)


def test_accuracies_are_learnt_from_agreements():
    rng = np.random.default_rng(0)
    meant = np.array([[t in kinds for t in TYPES] for _, kinds, _ in votes()])
    kind = rng.choice(4, 5000, p=[0.7, 0.1, 0.1, 0.1])
    fires = np.where(meant[:, kind].T, 0.9, 0.05)
    fires[:, 0] = 0.5  # a function that knows nothing
    codes = ((rng.random(fires.shape) < fires) << np.arange(len(meant))).sum(1)
    values, counts = np.unique(codes, return_counts=True)
    share, rate = learn(dict(zip(values.tolist(), counts.tolist())))
    assert abs(share[0] - 0.7) < 0.03 and abs(rate[0] - 0.5).max() < 0.1
    belief = posterior((codes[:, None] >> np.arange(len(meant))) & 1, share, rate)
    assert (belief.argmax(1) == kind).mean() > 0.97


def test_given_labels(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        return
    labels = {r["doc_id"]: r["label"] for r in spark.read.parquet(f"{folder}/doc_labels.parquet").collect()}
    got = {r["doc_id"]: r["type"] for r in classify(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert np.mean([(got[i] == PROSE) == (kind == PROSE) for i, kind in labels.items()]) >= 0.99
