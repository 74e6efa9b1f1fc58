"""Names, titles, paths and other text, as column expressions.

White space is white space by Unicode wherever text is trimmed or split, and an absent
text is the empty text, as in the stored tables.  A null argument gives null unless a
function says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinomill.functions.binding import bind, bind_list

#: Letters that lose their mark, letters that become two, words too general to search by, and codec names.
MARKED = "ÀÁÂÃÄÅàáâãäåÇçÐðÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöØøÙÚÛÜùúûüÝŸýÿŠšŽžŁł"
UNMARKED = "AAAAAAaaaaaaCcDdEEEEeeeeIIIIiiiiNnOOOOOoooooOoUUUUuuuuYYyySsZzLl"
DOUBLE = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss"}
GENERAL_WORDS = ("about", "after", "before", "from", "into", "movie", "the", "this", "with")
MATROSKA_CODECS = {
    "V_MPEG4/ISO/AVC": "h264", "V_MPEGH/ISO/HEVC": "hevc", "V_VP8": "vp8", "V_VP9": "vp9", "V_AV1": "av1", "V_MPEG4/ISO/ASP": "mpeg4", "V_MPEG2": "mpeg2video",
}
MP4_CODECS = {
    "avc1": "h264", "avc3": "h264", "hvc1": "hevc", "hev1": "hevc", "dvh1": "hevc", "dvhe": "hevc", "av01": "av1", "vp08": "vp8", "vp09": "vp9", "mp4v": "mpeg4", "mjpg": "mjpeg", "jpeg": "mjpeg",
}
TEN_BIT_FORMATS = ("yuv420p10le", "p010le", "yuv422p10le", "yuv444p10le")
CORRUPTION_MARKS = (
    "invalid nal", "error while decoding", "invalid data found", "conversion failed", "moov atom not found", "ebml header parsing failed",
    "unexpected eof", "end of file", "file ended prematurely", "corrupt", "truncated", "could not find codec parameters",
)
#: A length beyond any text.
WHOLE = 2**31 - 1
YEAR_IN_NAME = r"(?:^|[ ._\-\[\(])((?:18|19|20|21)\d{2})(?:$|[ ._\-\]\)])"


def trimmed(x: Column) -> Column:
    """Without white space at both ends. The look-behind keeps long runs inside a text linear."""
    return F.regexp_replace(x, r"(?U)^\s+|(?<!\s)\s+$", "")


def lowered(x: Column) -> Column:
    """Lower case letter by letter: a capital sigma gives the same small one everywhere."""
    return F.lower(F.translate(x, "Σ", "σ"))


def normalized(x: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(lowered(x), r"(?U)\s+", " "))


def loosely_normalized(x: Column) -> Column:
    """:func:`normalized` after Latin letters of a fixed list lose their marks; other letters keep theirs."""
    x = F.translate(x, MARKED, UNMARKED)
    for letter, pair in DOUBLE.items():
        x = F.replace(x, F.lit(letter), F.lit(pair))
    return normalized(x)


def present(x: Column) -> Column:
    """The text without the mark of a missing value, which becomes the empty text."""
    return F.when(x == "\\N", "").otherwise(x)


def comma_list(x: Column) -> Column:
    """Trimmed members; empty for the missing mark and the empty text. Empty members stay."""
    return F.when(x.isNull() | x.isin("\\N", ""), F.array().cast("array<string>")).otherwise(F.transform(F.split(x, ","), trimmed))


def first_present(*xs: Column) -> Column:
    """The first text that is not blank, else the empty text."""
    return F.coalesce(*(F.when(trimmed(x) != "", x) for x in xs), F.lit(""))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def clean_title(x: Column) -> Column:
    """Letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\p{L}\p{Nd}\s]", " "), r"(?U)\s+", " "))


def resolved_name(path: Column) -> Column:
    """A struct of ``title`` and ``year`` read from a file name: the leftmost year that stands apart, and the text before it."""
    stem = trimmed(F.regexp_replace(base_name(path), r"(?s)\.[^.]*$", ""))
    year = F.regexp_extract(stem, YEAR_IN_NAME, 1).try_cast("int")
    before = F.regexp_replace(stem, f"(?s)^(.*?){YEAR_IN_NAME}.*$", "$1")
    return F.struct(clean_title(before).alias("title"), year.alias("year"))


def _short_digest(x: Column, digits: int) -> Column:
    return F.substring(F.sha2(x, 256), 1, digits)


def entity_id(kind: Column, tmdb_id: Column, external_id: Column, title: Column, year: Column) -> Column:
    """A stable id: of the first of a positive number, an external id, and the title with its year."""
    kind = trimmed(kind)
    local = F.concat(kind, F.lit(":"), F.lower(trimmed(title)), F.coalesce(F.concat(F.lit(":"), year.cast("string")), F.lit("")))
    return (
        F.when(tmdb_id > 0, F.concat(kind, F.lit(":tmdb:"), tmdb_id.cast("string")))
        .when(trimmed(external_id) != "", F.concat(kind, F.lit(":external:"), F.lower(trimmed(external_id))))
        .otherwise(F.concat(kind, F.lit(":local:"), _short_digest(local, 16)))
    )


def profile_image_id(person: Column, path: Column) -> Column:
    person = person.cast("string")
    return F.concat(F.lit("person-image:tmdb:"), person, F.lit(":"), _short_digest(F.concat(person, F.lit(":"), trimmed(path)), 16))


def image_url(base: str, path: Column, size: str = "w500") -> Column:
    return F.when(trimmed(path) == "", "").otherwise(F.concat(F.lit(base + size), path))


def six_decimals(x: Column) -> Column:
    """A number with six decimals. Exact halves round to the even last digit of the decimal that the double stands for."""
    return F.format_string("%.6f", x)


def scene_id(media: Column, start: Column, end: Column, preview: Column) -> Column:
    return _short_digest(F.concat_ws(":", media, six_decimals(start), six_decimals(end), preview), 32)


def scene_text(*parts: Column) -> Column:
    """The parts that are not blank, joined by a space; the parts themselves are not trimmed."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (trimmed(p) != "")), " ")


def search_tokens(x: Column) -> Column:
    """Words of Latin letters and digits; then single Chinese characters, their pairs and their triples."""
    x = F.lower(x)

    def runs(signs: Column, n: int) -> Column:
        return F.when(
            F.size(signs) >= n, F.transform(F.sequence(F.lit(1), F.size(signs) - (n - 1)), lambda i: F.array_join(F.slice(signs, i, F.lit(n)), ""))
        ).otherwise(F.array().cast("array<string>"))

    signs = F.regexp_extract_all(x, F.lit(r"([\x{4e00}-\x{9fff}])"), 1)
    return F.concat(F.regexp_extract_all(x, F.lit("([a-z0-9]+)"), 1), bind_list(signs, lambda s: F.concat(s, runs(s, 2), runs(s, 3))))


def clock(seconds: Column) -> Column:
    """``HH:MM:SS``, cut to whole seconds; hours go on beyond 99."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)


def preview_reference(path: Column, url: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) != "", path).otherwise(url)


def preview_frame_index(reference: Column) -> Column:
    """The position that a frame's file name numbers from 1; -1 for other names."""
    name = F.regexp_extract(reference, r"([^/\\]*)$", 1)
    number = F.regexp_extract(name, r"^frame-([+-]?[0-9]+)(?:\.|$)", 1).try_cast("long")
    return F.when(number > 0, number - 1).otherwise(-1)


def normalized_path(x: Column) -> Column:
    """A drive letter becomes a mount point; other paths lose doubled slashes and single dots."""
    x = trimmed(x)
    drive = x.rlike(r"^[A-Za-z]:[\\/]")
    mounted = F.concat(F.lit("/mnt/"), F.lower(F.substring(x, 1, 1)), F.replace(F.substring(x, 3, WHOLE), F.lit("\\"), F.lit("/")))
    parts = F.filter(F.split(x, "/+"), lambda p: (p != "") & (p != "."))
    # a part and a following ".." cancel out; at the root ".." is dropped
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p != "..", F.concat(done, F.array(p)))
        .when((F.size(done) > 0) & (F.get(done, F.size(done) - 1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
        .when(x.startswith("/"), done)
        .otherwise(F.concat(done, F.array(p))),
    )
    clean = F.concat(F.when(x.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(x == "", "").when(drive, mounted).otherwise(F.when(clean == "", ".").otherwise(clean))


def frame_file_name(x: Column) -> Column:
    """The last component of a path or relative reference, decoded; empty for web addresses and for names that lead elsewhere."""
    x = trimmed(x)
    path = F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"[?#].*$", "")
    name = base_name(F.replace(path, F.lit("\\"), F.lit("/")))
    decoded = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    unfit = decoded.isin("", ".", "..") | decoded.contains("/") | decoded.contains("\\") | name.isin(".", "..")
    return F.when(x.rlike(r"^(?i)https?:") | unfit, "").otherwise(decoded)


def safe_file_name(x: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(trimmed(x), r"(?U)[^\p{L}\p{Nd}\-_.]", "_"), r"^[._]+|[._]+$", "")
    return F.when(name == "", "reference").otherwise(name)


def match_rank(x: Column, query: Column) -> Column:
    """0 equal, 1 begins with, 2 otherwise."""
    return F.when(x == query, 0).when(x.startswith(query), 1).otherwise(2)


def useful_token(x: Column) -> Column:
    return x.rlike("^[A-Za-z]+$") & ~x.isin(*GENERAL_WORDS)


def exact_variants(x: Column) -> Column:
    """The text as it is, in lower case, and in lower case with a capital first letter; each once."""
    x = trimmed(x)
    lower = F.lower(x)
    capital = F.concat(F.upper(F.substring(lower, 1, 1)), F.substring(lower, 2, WHOLE))
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(x, lower, capital)))


def lookup(x: Column, values: dict[str, str], default: Column) -> Column:
    out = default
    for key, value in values.items():
        out = F.when(x == key, value).otherwise(out)
    return out


def matroska_codec(x: Column) -> Column:
    return lookup(F.upper(trimmed(x)), MATROSKA_CODECS, F.lit(""))


def mp4_codec(x: Column) -> Column:
    return lookup(x, MP4_CODECS, x)


def download_format(x: Column) -> Column:
    return F.when(F.lower(trimmed(x)).isin(*TEN_BIT_FORMATS), "p010le").otherwise("nv12")


def is_corruption(x: Column) -> Column:
    """Whether a decoder's message tells of a damaged file."""
    return F.lower(x).rlike("|".join(CORRUPTION_MARKS))


def absolute_url(path: Column, host: Column, scheme: Column, forwarded_host: Column, forwarded_scheme: Column) -> Column:
    """``path`` behind the forwarded scheme and host where they are given; addresses and empty paths stay as they are."""
    where = F.concat(first_present(forwarded_scheme, scheme), F.lit("://"), first_present(forwarded_host, host))
    return F.when((path == "") | path.rlike("^https?://"), path).otherwise(F.concat(where, path))


def hint_score(title: Column, original: Column, query: Column, tokens: Column, same_year: Column) -> Column:
    """How well a catalogue title fits a searched text: the year, whole and partial agreement, and each useful word of the hints."""
    query = loosely_normalized(query)
    score = F.when(same_year, 1000).otherwise(0)
    for value in (title, original):
        value = loosely_normalized(F.coalesce(value, F.lit("")))
        score = score + F.when(
            value != "", F.when(value == query, 500).otherwise(0) + F.when(value.startswith(query), 10).otherwise(0) + F.when(value.contains(query), F.length(query)).otherwise(0)
        ).otherwise(0)
    both = F.array(normalized(F.coalesce(title, F.lit(""))), normalized(F.coalesce(original, F.lit(""))))

    def shared(values: Column) -> Column:
        found = F.filter(tokens, lambda t: useful_token(t) & F.exists(values, lambda v: v.contains(t)))
        return F.aggregate(found, F.lit(0), lambda total, t: total + 100 + F.length(t))

    return score + bind(both, shared)


def search_order(hints: Column) -> Column:
    """What to search for: useful words of four letters or more, the longest first, then the hints themselves; each once."""
    words = F.filter(F.flatten(F.transform(hints, lambda h: F.split(loosely_normalized(h), " "))), lambda w: (F.length(w) >= 4) & useful_token(w))
    by_length = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    return F.array_distinct(F.filter(F.concat(by_length, F.transform(hints, loosely_normalized)), lambda x: x != ""))


def cleaned_ids(xs: Column) -> Column:
    """Trimmed, without empty members, each once in the order of first appearance."""
    return F.array_distinct(F.filter(F.transform(xs, trimmed), lambda x: x.isNotNull() & (x != "")))


def title_hints(values: Sequence[Column]) -> Column:
    """Each value and what a file name of that form says, each once by its normalized form."""
    both = F.flatten(F.array(*(F.array(trimmed(F.coalesce(v, F.lit(""))), resolved_name(F.coalesce(v, F.lit("")))["title"]) for v in values)))
    kept = F.filter(both, lambda h: normalized(h) != "")
    pairs = F.transform(kept, lambda h: F.struct(h.alias("hint"), normalized(h).alias("key")))

    def first_of_key(pairs: Column) -> Column:
        firsts = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
        return F.transform(firsts, lambda p: p["hint"])

    return bind_list(pairs, first_of_key)


def local_preview(path: Column, url: Column) -> Column:
    """The preview that can be read from disk: the path, else the reference unless it is an address of a service; null if there is none."""
    found = trimmed(preview_reference(path, url))
    return F.when((found != "") & ~found.startswith("/v1/") & ~F.lower(found).rlike("^https?://"), found)
