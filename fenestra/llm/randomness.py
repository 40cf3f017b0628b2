"""Secret scan with a battery of randomness tests, with DataFrame functions only.

Three patterns find the usual secrets. On top, every long run of key-like characters that mixes
the character classes of an encoding (hex, base32 and base36 in either case, letters of both cases, base64) is tested for randomness:

* chi-squared: how uniform its characters are over the alphabet of the encoding,
* runs: how often it changes between letters, capitals, digits and signs,
* serial correlation: how far a character tells the next.

Each test asks whether the token is more random than a name or number written by people
would be, and gives a normal score; Stouffer's sum of the three is one p-value per token. Short
tokens carry less evidence, and there are far more of them, so the false-discovery rate is
controlled (Benjamini-Hochberg) within classes of length. The p-values are rounded up to a fixed
grid first: the ranking then is a histogram of at most a few thousand rows whatever the corpus.

Defined results: a null text is scanned like an empty one; repeated rows give repeated rows; an
empty table gives no rows. Positions count code points, ends are exclusive. Base spans always
stay; a ``random`` span is added only where it overlaps none of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from fenestra.llm.common import by_position, name_of

# The base patterns and the least lengths of their matches.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"  # 20 characters and more
HEX = "[0-9a-f]{24,}"
BASE = ["assign", "access", "hex"]

#: Tokens to be tested: this long and of these characters.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
FDR = 0.01
#: Lower ends of the length classes within which the false-discovery rate is controlled.
LENGTH_CLASSES = [20, 28, 40, 64]
#: Encoding -> (alphabet, and what the tests expect of names and numbers written in it: excess of chi-squared per
#: character, share of neighbours of different classes, correlation of neighbours).
ENCODINGS = {
    "hex": ("0123456789abcdef", 0.6, 0.2, 0.5),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.2, 0.15, 0.3),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", 1.35, 0.2, 0.3),
    "letters": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 1.5, 0.3, 0.2),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 1.2, 0.45, 0.2),
}
#: The grid of p-values: this many steps per power of ten, down to ten to the minus 60.
_STEPS, _LOWEST = 20, 60

#: Items that a growing list holds.
_BLOCK = 128
_SPAN = "array<struct<start:int,end:int,token:string>>"


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once and written once in the plan."""
    return F.transform(F.array(value), then)[0]


def running(items: Column, advance: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """``emit(at, item)`` of every item, where ``at`` starts at 0 and ``advance(at, item)`` is the next one.

    Lists grow inside blocks only, so the work is in proportion to the number of items. ``items`` is a bound value.
    """
    part = lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK))
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(blocks, first, lambda acc, b: F.struct(
        F.aggregate(part(b), acc["at"], advance).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]
    inside = lambda starts: F.flatten(F.transform(blocks, lambda b: F.aggregate(
        part(b), F.struct(F.get(starts, b).alias("at"), F.array().cast(kind).alias("out")), lambda acc, v: F.struct(
            advance(acc["at"], v).alias("at"), F.array_append(acc["out"], emit(acc["at"], v)).alias("out")))["out"]))
    return F.when(F.size(items) > 0, _bound(starts, inside)).otherwise(F.array().cast(kind))


def spans(text: Column, pattern: str) -> Column:
    """start, end and text of all leftmost matches: the pieces between them give the positions."""
    def located(pair: Column) -> Column:
        sized = F.zip_with(F.slice(pair["gaps"], F.lit(1), F.size(pair["found"])), pair["found"], lambda gap, token: F.struct(
            F.length(gap).alias("gap"), F.length(token).alias("n"), token.alias("token")))
        return _bound(sized, lambda items: running(items, lambda at, v: at + v["gap"] + v["n"], lambda at, v: F.struct(
            (at + v["gap"]).alias("start"), (at + v["gap"] + v["n"]).alias("end"), v["token"].alias("token")), _SPAN))

    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), _bound(pair, located)).otherwise(F.array().cast(_SPAN))


def tail(z: Column) -> Column:
    """P(Z >= z) of a standard normal; the bound of Börjesson and Sundberg is within 0.3 percent everywhere."""
    x = F.abs(z)
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) / (0.661 * x + 0.339 * F.sqrt(x * x + 5.51))
    return F.when(z >= 0, upper).otherwise(1 - upper)


def encoding(token: Column) -> Column:
    """The encoding whose character classes the token mixes; null for words and numbers."""
    has = lambda p: token.rlike(p)
    return (F.when(has("^[0-9a-f]+=*$|^[0-9A-F]+=*$") & has("[0-9]") & has("[A-Fa-f]"), "hex")
            .when(has("^[A-Z2-7]+=*$|^[a-z2-7]+=*$") & has("[A-Za-z]") & has("[2-7]"), "base32")
            .when(has("^[A-Z0-9]+=*$|^[a-z0-9]+=*$") & has("[A-Za-z]") & has("[0-9]"), "base36")
            .when(has("^[A-Za-z]+=*$") & has("[a-z]") & has("[A-Z]"), "letters")
            .when(has("[a-z]") & has("[A-Z]"), "base64"))


def _score(token: Column, by: Column) -> Column:
    """Stouffer's sum of the three scores; large for random tokens. ``by`` holds the values of the encoding."""
    k = F.length(by["alphabet"])
    n = F.length(token).cast("double")
    sum_of = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    counts = F.transform(by["letters"], lambda c: n - F.length(F.replace(token, c, F.lit(""))))
    chi = sum_of(F.transform(counts, lambda c: c * c)) * k / n - n
    shift = n * by["excess"]
    uniform = ((k - 1) + shift - chi) / F.sqrt(2 * (k - 1) + 4 * shift * (1 + by["excess"]))

    folded = token
    for characters, sign in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[^a-zA-Z0-9]+", "-")):
        folded = F.regexp_replace(folded, characters, sign)
    changes = F.length(folded) - 1.0
    runs = (changes - (n - 1) * by["written"]) / F.sqrt((n - 1) * by["written"] * (1 - by["written"]))

    def correlation(values: Column) -> Column:
        centred = _bound(sum_of(values) / n, lambda mean: F.transform(values, lambda v: v - mean))
        return _bound(centred, lambda c: F.when(
            sum_of(F.transform(c, lambda v: v * v)) > 0,
            sum_of(F.zip_with(F.slice(c, F.lit(1), F.length(token) - 1), F.slice(c, F.lit(2), F.length(token) - 1), lambda a, b: a * b))
            / sum_of(F.transform(c, lambda v: v * v))).otherwise(1.0))

    serial = _bound(F.transform(F.split(token, ""), lambda c: F.instr(by["alphabet"], c).cast("double")), correlation)
    serial_score = (by["told"] - F.abs(serial)) * F.sqrt(n) / by["told_norm"]
    return (uniform + runs + serial_score) / math.sqrt(3)


def grid(token: Column) -> Column:
    """Steps of the token's p-value on the grid, rounded towards 1; null where nothing is tested."""
    values = lambda alphabet, excess, written, told: F.struct(
        F.lit(alphabet).alias("alphabet"), F.array(*[F.lit(c) for c in alphabet]).alias("letters"), F.lit(excess).alias("excess"),
        F.lit(written).alias("written"), F.lit(told).alias("told"), F.lit(math.sqrt(1 - told ** 2)).alias("told_norm"))

    def steps(t: Column) -> Column:
        token, kind = t["token"], t["kind"]
        by = F.lit(None)
        for name, expected in ENCODINGS.items():
            by = F.when(kind == name, values(*expected)).otherwise(by)
        own = F.when(kind.isin("hex", "base36"), F.lower(token)).when(kind == "base32", F.upper(token)).otherwise(token)
        p = _bound(F.struct(own.alias("token"), by.alias("by")),
                   lambda x: F.greatest(_bound(_score(x["token"], x["by"]), tail), F.lit(10.0 ** -_LOWEST)))
        return F.when(kind.isNotNull(), F.floor(-F.log10(p) * _STEPS).cast("int"))

    kinds = lambda token: F.struct(token.alias("token"), encoding(token).alias("kind"))
    return _bound(F.regexp_replace(token, "=+$", ""), lambda token: _bound(kinds(token), steps))


def length_class(length: Column) -> Column:
    out = F.lit(LENGTH_CLASSES[0])
    for least in LENGTH_CLASSES[1:]:
        out = F.when(length >= least, least).otherwise(out)
    return out


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Kept columns, ``base`` spans and ``candidates`` with their place on the grid; one narrow pass."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    assigned = F.filter(spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 1)) >= ASSIGN_VALUE)
    tagged = lambda found, order, kind: F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    access = F.when(text.contains("AKIA"), spans(text, ACCESS)).otherwise(F.array().cast(_SPAN))
    found = [tagged(s, i, kind) for i, (s, kind) in enumerate(zip((assigned, access, spans(text, HEX)), BASE))]
    tested = F.transform(spans(text, TOKEN), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), grid(s["token"]).alias("grid")))
    kept = [F.col(f"`{c}`") for c in keep if c not in ("base", "candidates")]
    return docs.select(*kept, F.array_sort(F.concat(*found)).alias("base"),
                       F.filter(tested, lambda s: s["grid"].isNotNull()).alias("candidates"))


def thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Least grid step that counts as a discovery, per length class (Benjamini-Hochberg).

    The histogram has at most ``len(LENGTH_CLASSES) * (_STEPS * _LOWEST + 1)`` rows.
    """
    tests = scanned.select(F.explode("candidates").alias("c")).select(
        length_class(F.col("c.end") - F.col("c.start")).alias("length_class"), F.col("c.grid").alias("grid"))
    counts: dict[int, dict[int, int]] = {}
    for row in tests.groupBy("length_class", "grid").count().collect():
        counts.setdefault(row["length_class"], {})[row["grid"]] = row["count"]
    found = {}
    for least, by_step in counts.items():
        tested, seen = sum(by_step.values()), 0
        for step in sorted(by_step, reverse=True):
            seen += by_step[step]
            if 10.0 ** (-step / _STEPS) * tested <= fdr * seen:
                found[least] = step
    return found


def discoveries(scanned: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Add ``spans``: base spans and the random tokens beside them, by start."""
    passes = lambda s: F.lit(False)
    if limits:
        of = lambda s: F.coalesce(*[F.when(length_class(s["end"] - s["start"]) == k, v) for k, v in limits.items()])
        passes = lambda s: F.coalesce(s["grid"] >= of(s), F.lit(False))
    extra = F.transform(F.filter("candidates", passes), lambda s: F.struct(
        s["start"].alias("start"), F.lit(len(BASE)).alias("order"), s["end"].alias("end"), F.lit("random").alias("kind")))
    found = _bound(F.struct(F.col("base").alias("base"), extra.alias("extra")), lambda x: F.when(
        (F.size(x["base"]) > 0) & (F.size(x["extra"]) > 0), _bound(F.array_sort(F.concat(x["base"], x["extra"])), _free)).otherwise(
        F.array_sort(F.concat(x["base"], x["extra"]))))
    return scanned.withColumn("spans", found).drop("candidates")


def _free(found: Column) -> Column:
    """Base spans, and those other spans that overlap none of them: one walk for base spans that start before, one back for those after."""
    kind = "array<struct<start:int,order:int,end:int,kind:string,met:boolean>>"
    is_base, far = lambda s: s["order"] < len(BASE), (1 << 31) - 1
    named = lambda s, met: F.struct(*[s[f].alias(f) for f in ("start", "order", "end", "kind")], met.alias("met"))
    ahead = running(found, lambda at, s: F.when(is_base(s), F.greatest(at, s["end"])).otherwise(at), lambda at, s: named(s, at > s["start"]), kind)
    back = lambda spans: running(spans, lambda at, s: F.when(is_base(s), F.lit(far) - s["start"]).otherwise(at),
                                 lambda at, s: named(s, s["met"] | (F.lit(far) - at < s["end"])), kind)
    walked = F.filter(_bound(F.reverse(ahead), back), lambda s: is_base(s) | ~s["met"])
    return F.transform(F.reverse(walked), lambda s: F.struct(*[s[f].alias(f) for f in ("start", "order", "end", "kind")]))


def find_secrets(docs: DataFrame, keep: list[str], text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """Kept columns, ``base`` and ``spans``. Reads the texts twice: for the thresholds and for the spans."""
    scanned = scan(docs, keep, text_col)
    return discoveries(scanned, thresholds(scanned, fdr))


def listed(found: str) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: Column, found: Column, mask: str) -> Column:
    """``text`` with the mask in place of every group of overlapping spans; spans are ordered and not empty."""
    gap = "array<struct<start:int,end:int>>"
    gaps = running(found, lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.struct(at.alias("start"), s["start"].alias("end")), gap)
    cut = lambda text, start, end: F.substring(text, start + 1, end - start)

    def joined(gaps: Column) -> Column:
        # a block's text is cut out first, so no cut counts its way through the whole text
        part = lambda b: F.slice(gaps, b * _BLOCK + 1, F.lit(_BLOCK))
        block = lambda own: _bound(
            F.struct(F.get(own, F.lit(0))["start"].alias("at"), cut(text, F.get(own, F.lit(0))["start"], F.element_at(own, -1)["end"]).alias("text")),
            lambda whole: F.transform(own, lambda g: cut(whole["text"], g["start"] - whole["at"], g["end"] - whole["at"])))
        pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / _BLOCK).cast("int")), lambda b: _bound(part(b), block)))
        return F.concat(F.array_join(pieces, mask), F.lit(mask))

    end = F.array_max(F.transform(found, lambda s: s["end"]))
    return F.concat(_bound(F.filter(gaps, lambda g: g["start"] <= g["end"]), joined), F.substring(text, end + 1, F.length(text)))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every span of its texts exchanged for ``mask``; other columns stay, ``n_chars`` follows.

    Overlapping spans are masked once. Rows without a span are untouched.
    """
    rows, names = by_position(docs)
    text_name = name_of(names, text_col)
    text = F.col(text_name)
    found = find_secrets(rows, list(names), text_name, fdr)
    hit = F.size("spans") > 0
    done = found.withColumn(text_name, F.when(hit, _masked(text, F.col("spans"), mask)).otherwise(text))
    columns = {n: F.col(n) for n in names}
    if "n_chars" in docs.columns:
        n = name_of(names, "n_chars")
        columns[n] = F.when(hit, F.length(text_name).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n))
    return done.select(*[columns[n].alias(c) for n, c in names.items()])
