"""What kind of text a document is, from statistics that vote.

Each statistic and its threshold is a labelling function: it fires or it does not, and
it was meant to speak for one of the types prose, list, table and junk.  How far each
can be trusted is not set by hand.  The accuracies are learnt by expectation
maximization over the agreements of all documents: in turn, the posterior types of
every pattern of votes follow from the accuracies, and the accuracies from the
posteriors.  There are sixteen functions (:func:`votes`), so at most ``2 ** 16``
patterns, whatever the number of documents; only the counts of these patterns reach
the driver.

Defined cases:

* null, empty and blank texts have no type and no row;
* a document that comes several times has one row and counts once;
* statistics are taken over whole texts of any length;
* a tie of posteriors goes to the earlier type of :data:`TYPES`;
* columns of the input other than those named are ignored, whatever their names;
* an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinomill.lineage import cut

TYPES = PROSE, LIST, TABLE, JUNK = ("prose", "list", "table", "junk")

#: Common function words of the languages of the corpus.
COMMON_WORDS = (
    "the of and to in a is that it for on with as at by from this be are was were an or not but you his her they we he she which when where who because before after has have had"
    " its my our their me him them into out up down over under about near during against while then there so if no all one what how than just only"
    " le la les un une des du de et en est que qui dans pour sur avec au aux ne pas ce il elle nous vous on se son sa par plus mais ou y je tu sans sous comme tout près vers après quand si leur"
    " der die das den dem des ein eine einen einem und in ist zu mit von auf für nicht es sich bei aus als am im wenn weil bevor nach er sie wir ich du wo was wie nur noch so aber oder vor über um bis zum zur man"
    " el los las una unos y en es que de del con por para no se su al lo como más pero o mientras porque cuando antes cerca yo tu me mi le sin sobre hasta ya muy todo está"
).split()
COMMON_SIGNS = "的了在是我有和就不也都要你会着看好这那他她它们把被让从到与而之没"


def _count(text: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", ""))


def _measured(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the statistics of each row whose text is not blank."""
    # every pattern below runs in linear time: it starts only where its first sign stands and stops at the next one
    t = F.col("text")
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter(F.col("text").rlike(r"(?U)[^\s\p{Cf}]"))
    rows = rows.select(
        "key",
        "text",
        F.filter(F.split(F.lower(t), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(t, r"\R"), lambda x: x.rlike(r"(?U)\S")).alias("lines"),
        F.length(F.regexp_replace(t, r"(?U)\s+", "")).alias("inked"),
    )

    def lines(pattern: str) -> Column:
        return F.size(F.filter("lines", lambda x: x.rlike(pattern))) / F.size("lines")

    han = _count(t, r"\p{IsHan}")
    word_total = F.size("words") + han * 0.6
    rows = rows.select(
        "key",
        F.col("inked").alias("inked"),
        F.size("words").alias("word_count"),
        word_total.alias("word_total"),
        (F.col("inked") / F.greatest(F.size(F.split(F.trim(t), r"(?U)\s+")), F.lit(1))).alias("chunk_length"),
        F.when(F.size("words") > 0, F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)) / F.size("words")).otherwise(0.0).alias("mean_word_length"),
        (F.size(F.filter("words", lambda w: w.isin(*dict.fromkeys(COMMON_WORDS)))) / F.greatest(F.size("words"), F.lit(1))).alias("common_words"),
        # long lists of signs are slow as patterns, so they are looked for only where they can be
        (F.when(han > 0, F.length(t) - F.length(F.translate(t, COMMON_SIGNS, ""))).otherwise(0) / F.greatest(han, F.lit(1))).alias("common_signs"),
        (han / F.col("inked")).alias("han"),
        (_count(t, r"\p{L}\p{M}") / F.col("inked")).alias("letters"),
        (_count(t, r"0-9") / F.col("inked")).alias("digits"),
        (_count(t, r"{}\[\]<>=|\\/#@$%^&*_~`+") / F.col("inked")).alias("symbols"),
        (_count(F.regexp_replace(t, r"[\x00-\x7F]+", ""), r"\x{FFFD}\x{80}-\x{9F}\x{2500}-\x{25FF}\x{2190}-\x{21FF}\x{2200}-\x{22FF}¢£¥§¨©¬®¯°±¶¸¹º¼½¾ÂÃ") / F.col("inked")).alias("debris"),
        (F.regexp_count(t, F.lit(r"(?<=[\p{L}\"'”»’)*_])[.!?…]++[\"'”»)\]*_]*+(?=\s|$)|[。！？]")) / F.greatest(word_total, F.lit(1.0))).alias("sentence_ends"),
        lines(r"(?U)[.!?…。！？][\"'”»’)\]*_]*\s*\z").alias("ended_lines"),
        lines(r"(?U)\A\s*(?:[-*•→·▪◦+]\s|\d{1,3}[.)]\s|[a-z][.)]\s|\[[ xX]?\]|#\w)").alias("bulleted_lines"),
        lines(r"(?U)\A.{0,70}[^.!?…。！？:\"'”»\s]\s*\z").alias("bare_lines"),
        lines(r"\t|\|[^|]*\||;[^;]+;|,[^,\s]+,|<t[dr]>|\S {3,}\S|\+--").alias("celled_lines"),
        lines(r"\d{4}-\d\d-\d\d[T ]\d|\"\s*:\s|\{[^{}]*\}|^\[ \p{L}|^[0-9a-f]{8} |\w=\w| > ").alias("machine_lines"),
        t.rlike("<td>.*<td>").alias("markup_cells"),
        F.size("lines").alias("line_count"),
        (F.regexp_count(t, F.lit(r"(?U)\s[|·•/→;]\s|[;|]")) / F.greatest(word_total, F.lit(1.0))).alias("separators"),
        (F.size(F.array_distinct("words")) / F.greatest(F.size("words"), F.lit(1))).alias("distinct_words"),
    )
    return rows


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the statistics of each text that is not blank; of several texts of a key, the one of the smallest statistics."""
    rows = _measured(df, key, text)
    return rows.groupBy("key").agg(F.min(F.struct(*rows.columns[1:])).alias("s")).select("key", "s.*")


def votes() -> list[tuple[str, tuple[str, ...], Column]]:
    """Name, types spoken for, and condition of each labelling function."""
    c = F.col
    spoken = (c("common_words") >= 0.12) | ((c("han") > 0.3) & (c("common_signs") >= 0.03))
    rowed = (c("celled_lines") >= 0.7) & (c("machine_lines") < 0.5) & (c("bulleted_lines") < 0.5) & ((c("symbols") < 0.3) | c("markup_cells"))
    return [
        ("function_words", (PROSE,), spoken),
        ("sentences", (PROSE,), (c("sentence_ends") >= 0.01) & (c("sentence_ends") < 0.34) & spoken),
        ("ended_lines", (PROSE,), c("ended_lines") >= 0.5),
        ("mostly_letters", (PROSE,), (c("letters") >= 0.85) & (c("mean_word_length") < 9)),
        ("bullets", (LIST,), c("bulleted_lines") >= 0.6),
        ("bare_lines", (LIST,), (c("bare_lines") >= 0.7) & (c("line_count") >= 3) & ~rowed & (c("machine_lines") < 0.5)),
        ("separated", (LIST,), (c("separators") >= 0.1) & (c("sentence_ends") < 0.02) & (c("line_count") == 1) & (c("symbols") < 0.1)),
        ("cells", (TABLE,), rowed),
        ("numbers", (TABLE,), (c("digits") >= 0.12) & rowed),
        ("no_sentences", (LIST, TABLE, JUNK), c("sentence_ends") < 0.01),
        ("symbols", (JUNK,), (c("symbols") >= 0.1) & ~rowed & (c("bulleted_lines") < 0.5)),
        ("debris", (JUNK,), c("debris") >= 0.06),
        ("machine", (JUNK,), (c("machine_lines") >= 0.6) & (c("bulleted_lines") < 0.5)),
        ("unspoken", (TABLE, JUNK), ~spoken & (c("word_total") >= 4)),
        ("repeats", (JUNK,), (c("distinct_words") <= 0.35) & (c("word_count") >= 20) & ~rowed),
        ("long_chunks", (JUNK,), (c("chunk_length") >= 14) & (c("han") < 0.3) & ~rowed & (c("bulleted_lines") < 0.5)),
    ]


#: How often a function is taken to fire at first: in documents of the type it speaks for, and in others.
FIRST_HIT, FIRST_FALSE, FIRST_SHARES = 0.7, 0.1, (0.7, 0.1, 0.1, 0.1)
ROUNDS, PRIOR = 60, 1.0


def learn(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """From the number of documents of each pattern, the share of each type and how often each function fires in it."""
    meant = np.array([[t in kinds for t in TYPES] for _, kinds, _ in votes()])
    codes = np.array(sorted(counts), np.int64)
    fired = (codes[:, None] >> np.arange(len(meant))) & 1
    weight = np.array([counts[c] for c in codes.tolist()], float)
    rate, share = np.where(meant, FIRST_HIT, FIRST_FALSE), np.array(FIRST_SHARES)
    for _ in range(ROUNDS):
        belief = posterior(fired, share, rate) * weight[:, None]
        share = (belief.sum(0) + PRIOR) / (weight.sum() + PRIOR * len(TYPES))
        rate = (fired.T @ belief + PRIOR * np.where(meant, FIRST_HIT, FIRST_FALSE)) / (belief.sum(0) + PRIOR)
    return share, rate


def posterior(fired: np.ndarray, share: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The probability of each type for each row of votes."""
    odds = np.log(share) + fired @ np.log(rate) + (1 - fired) @ np.log1p(-rate)
    odds = np.exp(odds - odds.max(1, keepdims=True))
    return odds / odds.sum(1, keepdims=True)


def classify(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, type, confidence)`` for each text that is not blank."""
    spark = df.sparkSession
    code = sum((F.when(fires, F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, _, fires) in enumerate(votes())), F.lit(0))
    # only keys and codes are shuffled, not texts
    coded = cut(_measured(df, key, text).select("key", code.alias("code")).groupBy("key").agg(F.min("code").alias("code")))
    counts = {r["code"]: r["count"] for r in coded.groupBy("code").count().collect()}  # at most 2 ** len(votes())
    share, rate = learn(counts)
    codes = np.array(sorted(counts), np.int64)
    belief = posterior((codes[:, None] >> np.arange(len(rate))) & 1, share, rate) if len(codes) else np.zeros((0, len(TYPES)))
    table = [(int(c), TYPES[int(b.argmax())], float(b.max())) for c, b in zip(codes, belief, strict=True)]
    types = spark.createDataFrame(table, "code int, type string, confidence double")
    return coded.join(F.broadcast(types), "code").select(F.col("key").alias(key), "type", "confidence")
