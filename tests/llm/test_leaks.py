import random
from collections import Counter

import numpy as np

from kinomill.llm import leaks
from kinomill.llm.leaks import Fingerprinter, ItemWindows, find_leaks, plain_words, similarities

ITEM = "The quick brown fox jumps over the lazy dog near Élan Vital and the old œuvre of Straße sleeps quietly today"
OTHER = "un deux trois quatre cinq six sept huit neuf dix onze douze treize"


def found(spark, docs, items, least=10, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, words string")
    i = spark.createDataFrame(items, "item_id bigint, text string, doc string")
    return {(r["doc_id"], r["item_id"], r["words"]) for r in find_leaks(d, i, **kw).collect() if r["words"] >= least}


def test_changed_writing_is_found_and_nine_words_are_not(spark):
    words = ITEM.split()
    ten, nine = words[3:13], words[3:12]
    docs = [
        (1, "intro " + " ".join(ten) + " outro", ""), (2, "intro " + " ".join(nine) + " outro", ""), (3, ITEM.upper(), ""), (4, "<b>" + "</b> **".join(words) + "**", ""),
        (5, " \n".join(w[:1] + "​­" + w[1:] for w in words), ""), (6, ITEM.replace("É", "E").replace("œ", "oe").replace("ß", "ss"), ""), (7, ITEM.replace("É", "É"), ""),
        (8, " ".join(w if k % 5 else "other" for k, w in enumerate(words)), ""), (9, None, ""), (10, "", ""), (11, "- ".join(w + "," for w in words), ""),
    ]
    n = len(words)
    assert found(spark, docs, [(1, ITEM, ""), (2, OTHER, ""), (3, None, ""), (4, "too short", "")]) == {(1, 1, 10), (3, 1, n), (4, 1, n), (5, 1, n), (6, 1, n), (7, 1, n), (11, 1, n)}


def test_repeated_rows_and_long_texts(spark):
    rng = random.Random(3)
    filler = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60_000))
    docs = [(1, filler + " " + ITEM, ""), (1, filler + " " + ITEM, ""), (2, filler, "")]
    assert found(spark, docs, [(1, ITEM, ""), (1, ITEM, "")]) == {(1, 1, len(ITEM.split()))}


def test_empty_tables(spark):
    assert found(spark, [], [(1, ITEM, "")]) == found(spark, [(1, ITEM, "")], []) == set()


def test_blocks_of_items_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(leaks, "QUERY_WINDOWS", 7)
    assert found(spark, [(1, ITEM, ""), (2, OTHER, "")], [(1, ITEM, ""), (2, OTHER, "")], least=1) >= {(1, 1, 16), (2, 2, 13)}


def test_every_window_within_the_radius_is_met():
    rng = np.random.default_rng(0)
    items = ItemWindows(3, 3, keys=[0], words=[[f"w{i}" for i in range(400)]]).seal()
    own = items.by_size[3][2]
    flips = np.zeros(2000, np.uint64)
    base = rng.integers(0, len(own), 2000)
    for _ in range(3):
        flips |= np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)
    asked = own[base] ^ flips
    place, wanted = items.near(asked, 3)
    assert set(zip(range(2000), base.tolist())) <= set(zip(place.tolist(), wanted.tolist()))
    assert set(zip(place.tolist(), wanted.tolist())) == {(p, w) for p in range(2000) for w in np.flatnonzero(np.bitwise_count(own ^ asked[p]) <= 3).tolist()}


def test_an_item_with_a_changed_word_is_found_by_its_own_window(spark):
    words = [f"zebrafish{i}" for i in range(20)]
    close = [*words[:9], "a", *words[10:19], "b"]  # no ten words in a row are left
    d = spark.createDataFrame([(1, "before " + " ".join([*words[:19], "a"]) + " after"), (2, " ".join(close))], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    rows = {r["doc_id"]: (r["words"], round(r["similarity"], 2)) for r in find_leaks(d, i, radius=15, similarity=0.8).collect()}
    assert rows[1] == (19, 1.0) and 2 not in rows
    near = {r["doc_id"]: (r["words"], round(r["similarity"], 2)) for r in find_leaks(d, i, radius=15, similarity=0.5).collect()}
    # the best is a short window, of whose six shingles of five words (40 letters each) the last one holds the second change
    assert near[2] == (0, round(5 * 40 / (5 * 40 + 40 + 33), 2))


def test_similarities_against_counters():
    rng = random.Random(1)
    rows = [([rng.randrange(4) for _ in range(6)], [rng.randrange(4) for _ in range(6)]) for _ in range(50)]
    weight = {i: 3 + i for i in range(4)}
    a, b = (np.array([r[k] for r in rows], np.uint64) for k in (0, 1))
    weights = [np.vectorize(lambda x: weight[int(x)])(x) for x in (a, b)]
    for got, (x, y) in zip(similarities((a, weights[0]), (b, weights[1])), rows):
        x, y = Counter(x), Counter(y)
        assert abs(got - sum((x & y)[i] * weight[i] for i in weight) / sum((x | y)[i] * weight[i] for i in weight)) < 1e-12


def test_wrapped_sums_give_the_same_fingerprints():
    rng = random.Random(2)
    prints = Fingerprinter()
    ids = prints.look_up(["".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))) for _ in range(3000)])
    for size, got in zip((10, 20, 320), prints.windows(ids, [10, 20, 320])):
        for at in rng.sample(range(len(got)), 40):
            sums = prints.signs[ids[at : at + size]].astype(int).sum(0)
            assert got[at] == np.packbits(sums > 0).view(np.uint64)[0]


def test_slices_of_a_long_text_lose_no_passage(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    assert all(part[:17] == words[s : s + 17] for s, part in zip(range(0, 400, 8), sliced(words, 9, 8)))
    assert {tuple(p[i : i + 10]) for p in sliced(words, 9, 8) for i in range(len(p) - 9)} == {tuple(words[i : i + 10]) for i in range(391)}


def sliced(words, overlap, size):
    before, leaks.BATCH_WORDS = leaks.BATCH_WORDS, size
    try:
        return list(leaks._slices(words, overlap))
    finally:
        leaks.BATCH_WORDS = before


def test_words_and_fingerprints():
    assert plain_words("L’Été d'Émile — x<br/>y &c.") == ["l", "ete", "d", "emile", "x", "y", "c"]
    prints = Fingerprinter()
    assert len(prints.windows(prints.look_up(["a"] * 9), [10])[0]) == 0
