import random

import numpy as np

from kinomill.llm.matching import KEY_BYTES, Slide, file_title, letter_bits, match_records, name_forms, sieve, slips

ENTRIES = [
    ("t1", "Return to Raryvolo", 1982, 152), ("t2", "Return to Raryvolo 2", 1987, None), ("t3", "Return to Raryvolo: Part III", 1989, 171), ("t4", "The Silent Orchard of Zaluhysk", 2017, 94), ("t5", "Himosami", 1990, 80),
    ("t6", "Himosami", 2005, 100), ("t3", "拿瑞沃伊的镜子3", 1989, 171), ("t7", "Letters from Ditolex", None, 76), ("t8", "El jardín de Zoynador", 2010, 90), ("t1", "Return to Raryvolo", 1982, 152), ("t9", None, 2000, 90),
]


def matched(spark, records, entries=ENTRIES):
    e = spark.createDataFrame(entries, "entry string, name string, year int, minutes int")
    r = spark.createDataFrame([(*x, "extra") for x in records], "key string, names array<string>, year int, seconds double, confidence string")
    return {x["key"]: x["entry"] for x in match_records(e, r).collect()}


def test_noisy_names(spark):
    records = [
        ("a", ["Retrun to Raryvolo 1080p GUNOR"], 1982, None), ("b", ["ReturnToRaryvolo II [HD]"], 1988, None), ("c", ["Return to Raryvolo"], 1990, None), ("d", ["Silent Orchard of Zaluhysk, The"], None, 5641.0),
        ("e", ["Himosami"], None, 6010.0), ("f", ["himosami"], 1991, None), ("g", ["拿瑞沃伊的镜子3"], None, None), ("h", ["lettersfromditolex"], None, None), ("i", ["Holiday clip 48"], None, 900.0), ("j", ["El jardin de Zoyandor"], 2011, 5400.0),
        ("k", [None, ""], 1982, None), ("l", ["Himosami"], 1990, 9000.0), ("m", [None, "Return to Raryvolo (1982)"], None, None), ("a", ["Retrun to Raryvolo 1080p GUNOR"], 1982, None),
    ]
    assert matched(spark, records) == {"a": "t1", "b": "t2", "d": "t4", "e": "t6", "f": "t5", "g": "t3", "h": "t7", "j": "t8", "m": "t1"}


def test_ties_go_to_the_smaller_entry(spark):
    assert matched(spark, [("a", ["Himosami"], None, None)]) == {"a": "t5"}


def test_several_records_of_one_entry_and_copies(spark):
    records = [(f"r{i}", ["The Silent Orchard of Zaluhysk"], 2017, None) for i in range(300)] + [("x", ["Silent Orchard of Zaluhysk"], 2016, 5700.0)]
    assert matched(spark, records) == {k: "t4" for k, *_ in records}


def test_empty_tables(spark):
    assert matched(spark, []) == {} == matched(spark, [("a", ["x"], 1, 1.0)], [])


def test_windows_reach_over_partition_ends(spark, monkeypatch):
    rng = random.Random(1)
    names = sorted({"".join(rng.choice("bdfgklmnprst") + rng.choice("aeiouy") for _ in range(4)) for _ in range(400)})
    entries = [(f"e{i}", n.title(), 1950 + i % 60, None) for i, n in enumerate(names)]
    records = [(f"r{i}", [n[:3] + n[4] + n[3] + n[5:]], 1950 + i % 60, None) for i, n in enumerate(names)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = matched(spark, records, entries)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(got.get(f"r{i}") == f"e{i}" for i in range(len(names))) > 0.98 * len(names)


def by_brute_force(records, entries):
    """The best entry of each record among all entries."""
    best = {}
    forms = lambda names: {f for n in names for f in name_forms(n)[:2]}
    pairs = [(a, b) for a in forms(n for r in records for n in r[1]) for b in forms(e[1] for e in entries)]
    apart_by = dict(zip(pairs, slips([a for a, _ in pairs], [b for _, b in pairs], 3).tolist()))
    for key, names, year, seconds in records:
        for name in names:
            whole, telling, number, _ = name_forms(name)
            for entry, other, e_year, minutes in entries:
                e_whole, e_telling, e_number, _ = name_forms(other)
                apart = None if year is None or e_year is None else abs(year - e_year)
                off = None if seconds is None or minutes is None else abs(seconds - minutes * 60)
                n = min(apart_by[whole, e_whole], apart_by[telling, e_telling])
                longer = max(len(telling), len(e_telling))
                if number != e_number or (apart or 0) > 1 or (off or 0) >= 120 or n > 1 + (apart is not None) + (off is not None) or n > 0.34 * longer:
                    continue
                sure = 0.7 * (1 - n / longer) + 0.15 * (0.6 if apart is None else 1 - 0.3 * apart) + 0.15 * (0.6 if off is None else 1 - 0.2 * off / 120)
                best[key] = min(best.get(key, (0, "")), (-round(sure, 6), entry))
    return {k: e for k, (_, e) in best.items()}


def test_hot_titles_against_brute_force(spark):
    rng = random.Random(7)
    long = [f"Chronicle of the Long River {''.join(rng.choice('bdgkmnprst') + rng.choice('aeiou') for _ in range(3))}" for _ in range(60)]
    entries = [(f"a{i:03d}", "Himosami", 1990, 40 + 4 * i) for i in range(60)]  # only the running time tells them apart
    entries += [(f"b{i:03d}", "Raryvolo", None, 40 + 4 * i) for i in range(60)] + [(f"c{i:03d}", "Zoynador", 1900 + 2 * i, 90) for i in range(60)]
    entries += [(f"d{i:03d}", n, 1970, 100) for i, n in enumerate(long)] + [(f"e{i:03d}", "HIMOSAMI!" + "!" * i, 1991, None) for i in range(30)]
    records = []
    for i in range(60):
        records += [(f"a{i}", ["Himosami"], 1990, 60.0 * (40 + 4 * i)), (f"b{i}", ["Raryvolo"], 2000 if i % 2 else None, 60.0 * (40 + 4 * i)), (f"c{i}", ["Zoynador"], 1900 + 2 * i, None if i % 2 else 5400.0)]
        records += [(f"d{i}", [long[i]], 1970, None), (f"n{i}", ["Himosmai"], 1990, 60.0 * (40 + 4 * i) + 20), (f"o{i}", ["Himosami"], None, 60.0 * (40 + 4 * i))]
    records += [("p", ["Himosami"], 1990, None), ("q", ["Raryvolo"], None, None)]
    right = by_brute_force(records, entries)
    assert len(right) == len(records)
    assert matched(spark, records, entries) == right


def test_very_long_names(spark):
    assert matched(spark, [("a", ["x" * 5000], 2000, None), ("b", ["y " * 5000], None, None)], [("t", "x" * 5000, 2000, None)]) == {"a": "t"}


def test_forms():
    assert name_forms("Nyazom: Part III")[:3] == ("nyazom", "nyazom", 3)
    assert name_forms("A Border for Rysypus 2160p-X")[0] == "aborderforrysypus"
    assert name_forms(None)[0] == "" == name_forms("!!")[0]
    assert file_title("1984 - Kitínoka Nights.ts") == "Kitínoka Nights"
    assert file_title("Storm_in_Hegitork (1968) 720p.mp4") == "Storm in Hegitork"
    assert file_title(None) is None


def test_slips_against_a_plain_table():
    def plain(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(0)
    pairs = [["".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2)] for _ in range(3000)]
    assert slips([a for a, _ in pairs], [b for _, b in pairs], 3).tolist() == [min(plain(a, b), 4) for a, b in pairs]


def measures(names):
    return {
        "number": np.ones(len(names), int), "long": np.array(list(map(len, names))), "told": np.array(list(map(len, names))),
        "whole_bits": np.array(list(map(letter_bits, names))), "telling_bits": np.array(list(map(letter_bits, names))),
    }


def test_the_sieve_drops_no_pair_within_the_slips():
    rng = random.Random(2)
    pairs = []
    for _ in range(4000):
        a = "".join(rng.choice("abcdéz冬") for _ in range(rng.randint(1, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a", "冬"])
        pairs.append((a, "".join(b) or "a"))
    n = slips([a for a, _ in pairs], [b for _, b in pairs], 3)
    longer = np.array([max(len(a), len(b)) for a, b in pairs])
    passed = sieve(measures([a for a, _ in pairs]), measures([b for _, b in pairs]), 3)
    assert passed[(n <= 3) & (n <= 0.34 * longer)].all() and not passed.all()


def test_a_window_in_parts_meets_what_a_whole_one_meets():
    rng = random.Random(4)
    names = sorted("".join(rng.choice("ab") for _ in range(10)) for _ in range(600))
    kinds = np.array([rng.random() < 0.6 for _ in names], int)
    rows = measures(names) | {"key": np.array([b"A1JK" + n.encode() for n in names], f"S{KEY_BYTES}"), "kind": kinds, "id": np.arange(600)}

    def met(size):
        slide, found = Slide(size), set()
        for start in range(0, 600, 7):
            slide.add({k: v[start : start + 7] for k, v in rows.items()})
            if slide.full():
                found |= {p for r, e in slide.pairs(False) for p in zip(r.tolist(), e.tolist())}
        return found | {p for r, e in slide.pairs(True) for p in zip(r.tolist(), e.tolist())}

    assert met(50) == met(10**6) != set()
