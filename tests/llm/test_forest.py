import random

from pyspark.sql import functions as F

from kinomill.llm import forest as forest_module
from kinomill.lineage import list_path
from kinomill.llm.forest import HashForest, canonical, estimated_recall, prefix_widths, ranges_of


def hex_of(n):
    return f"{n:064x}"


def flipped(rng, n, bits):
    for b in rng.sample(range(256), bits):
        n ^= 1 << b
    return n


def frame(spark, rows):
    df = spark.createDataFrame(rows, "key bigint, written string, rank int")
    return df.select("key", canonical(F.col("written")).alias("content"), F.struct("key").alias("record"))


def run(spark, batches):
    forest = HashForest(spark)
    for batch in batches:
        forest.accept(frame(spark, batch))
    everything = frame(spark, [r for b in batches for r in b])
    return {r["key"]: r["first"]["key"] for r in forest.seen_before(everything).collect()}, forest


def brute(batches):
    seen, out = [], {}
    for key, content in sorted({(k, w) for b in batches for k, w, _ in b}):
        if content is None or content in ("", "pending"):
            continue
        for k, c in seen:
            same = c == content.strip().lower() if content.strip().lower().startswith("remote:") or c.startswith("remote:") else (int(c, 16) ^ int(content, 16)).bit_count() <= 12
            if same:
                out[key] = k
                break
        seen.append((key, content.strip().lower()))
    return out


def random_batches(rng, batches=6, size=60, hot=False):
    bases = [rng.getrandbits(256) for _ in range(12)]
    out, key = [], 0
    for _ in range(batches):
        rows = []
        for _ in range(size):
            base = bases[0] if hot and rng.random() < 0.5 else rng.choice(bases)
            kind = rng.random()
            text = hex_of(flipped(rng, base, rng.choice([0, 1, 6, 12, 13, 14, 20]))) if kind < 0.75 else rng.choice([None, "", "pending", f"remote:{rng.randint(0, 9)}", hex_of(rng.getrandbits(256))])
            rows.append((key, text, 1))
            key += 1
        out.append(rows + rows[:3])
    return out


def test_against_brute_force(spark):
    batches = random_batches(random.Random(5))
    got, forest = run(spark, batches)
    assert got == brute(batches)
    assert len(forest.runs) < len(batches)  # runs were merged


def test_crowded_ranges(spark, monkeypatch):
    monkeypatch.setattr(forest_module, "SLOTS", 2)
    batches = random_batches(random.Random(6), batches=3, size=80, hot=True)
    assert run(spark, batches)[0] == brute(batches)


def test_ways_of_writing(spark):
    plain = hex_of(0xABCDEF << 200)
    groups = ":".join(plain[i : i + 8] for i in range(0, 64, 8))
    written = [plain, plain.upper(), f"  {plain}\n", "0x" + plain, "VF:" + plain, "vf256:" + plain, "frames=" + plain, groups, groups.replace(":", "-"), groups.replace(":", " "), "vf: " + groups]
    bad = [plain[:-1], plain + "0", "", " ", None, "pending", "g" * 64, "remote", plain[:32]]
    df = spark.createDataFrame([(w,) for w in [*written, *bad]], "w string").select(canonical(F.col("w")).alias("c"))
    assert [r["c"] for r in df.collect()] == [plain] * len(written) + [None] * len(bad)
    remote = spark.createDataFrame([(" REMOTE:A:1\n",)], "w string").select(canonical(F.col("w")).alias("c")).first()["c"]
    assert remote == "remote:a:1"


def test_empty_and_unusable_batches(spark):
    forest = HashForest(spark)
    forest.accept(frame(spark, []))
    assert forest.seen_before(frame(spark, [(1, hex_of(5), 1)])).count() == 0
    forest.accept(frame(spark, [(1, None, 1), (2, "", 1)]))
    forest.accept(frame(spark, [(3, "remote:x", 1)]))
    forest.accept(frame(spark, [(4, hex_of(7), 1), (5, "Remote:X", 1)]))
    forest.accept(frame(spark, []))
    rows = forest.seen_before(frame(spark, [(3, "remote:x", 1), (4, hex_of(7), 1), (5, "remote:x", 1)])).collect()
    assert [(r["key"], r["first"]["key"]) for r in rows] == [(5, 3)]


def test_prefixes_widen_until_the_target():
    assert sum(prefix_widths(1.0)) == 64 and max(prefix_widths(1.0)) == 5
    assert estimated_recall(4) == 1.0
    assert all(estimated_recall(w) >= estimated_recall(w + 1) for w in range(4, 16))
    assert min(prefix_widths(0.9)) >= 4 and estimated_recall(min(prefix_widths(0.9))) >= 0.9


def test_a_forest_is_opened_again(spark):
    batches = random_batches(random.Random(8), batches=5, size=40)
    _, forest = run(spark, batches[:3])
    again = HashForest.open(spark, forest.path)
    assert again.runs == forest.runs
    for batch in batches[3:]:
        again.accept(frame(spark, batch))
    # nothing but runs and one manifest is left in the folder
    stored = {name for r in again.runs for name in (r["entries"], r["rest"], r["ledger"]) if name}
    left = set(list_path(spark, forest.path))
    assert {n for n in left if not n.startswith("manifest-")} == stored and len(left) == len(stored) + 1
    everything = frame(spark, [r for b in batches for r in b])
    assert {r["key"]: r["first"]["key"] for r in HashForest.open(spark, forest.path).seen_before(everything).collect()} == brute(batches)
    assert HashForest.open(spark, forest.path + "-absent").runs == []


def test_a_small_batch_reads_only_its_ranges(spark):
    rng = random.Random(9)
    history = [(i, hex_of(rng.getrandbits(256)), 1) for i in range(6000)]
    forest = HashForest(spark)
    forest.accept(frame(spark, history))
    near = hex_of(flipped(rng, int(history[5][1], 16), 12))
    asked = []
    sparse = forest._sparse
    forest._sparse = lambda stored, *args: asked.append((stored, found := sparse(stored, *args))) or found
    forest.accept(frame(spark, [(7000, near, 1)]))
    whole, part = next((a, b) for a, b in asked if "at" in a.columns)

    def rows_read(df):
        plan = df._jdf.queryExecution().executedPlan()
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        scans = plan.collectLeaves()
        return sum(scans.apply(i).metrics().apply("numOutputRows").value() for i in range(scans.size()))

    assert rows_read(part.select("at")) < 0.6 * rows_read(whole.select("at"))
    assert {r["key"]: r["first"]["key"] for r in forest.seen_before(frame(spark, [(7000, near, 1)])).collect()} == {7000: 5}


def test_ranges():
    assert ranges_of([]) == [] and ranges_of([4]) == [(4, 4)]
    assert ranges_of([1, 2, 3, 50, 51, 90], 3) == [(1, 3), (50, 51), (90, 90)]
