"""Text predicates and field extraction for page text and offer forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from fenestra.functions.binding import bind, to_number
from fenestra.functions.inches import mixed_fraction

# fixed values: page vocabulary and field patterns
SCHEDULE_TITLE = r"(?i)(window|door)\s+schedule"
UNIT_TABLE_TITLE = "ROUGH OPENING"
UNIT_TABLE_WORDS = ("UNIT", "MARK", "WINDOW", "DOOR")
PROFILE_PATTERNS = {"weather_shield": (r"weather", r"shield")}
LEVEL_WORDS = ("FIRST LEVEL", "SECOND LEVEL", "THIRD LEVEL", "FOURTH LEVEL", "FIFTH LEVEL")
ELEVATION_WORDS = LEVEL_WORDS + ("T.O. PARAPET", "ELEVATION")
FRAME_FIELD = r"(?m)Frame size:\s*([0-9].*?)\s*$"
ROUGH_OPENING_FIELD = r"(?m)Rough opening:\s*([0-9].*?)\s*$"
DIMENSION_PAIR = r'([0-9]+(?:\s+\d+/\d+)?)\s*"?\s*[xX]\s*([0-9]+(?:\s+\d+/\d+)?)'
EGRESS_FIELD = r"Egress:\s*YES"
PRICE_BLOCK = (r"(\d+)\n([\d,]+\.\d{2})\n-\n([\d,]+\.\d{2})\n-\n(\d+)\n"
               r"([\d,]+\.\d{2})\n([\d,]+\.\d{2})\nAccessories")
PROFILE_MARK = "Profile:"


def has_unit_table(text: Column) -> Column:
    """A window or door schedule title, or a rough-opening column next to a unit word."""
    up = F.upper(text)
    words = reduce(lambda a, b: a | b, [up.contains(w) for w in UNIT_TABLE_WORDS])
    return text.rlike(SCHEDULE_TITLE) | (up.contains(UNIT_TABLE_TITLE) & words)


def detect_profile(text: Column) -> Column:
    """Notation profile named in the text, or NULL."""
    out = F.lit(None).cast("string")
    for name, words in reversed(PROFILE_PATTERNS.items()):
        out = F.when(text.rlike(r"(?i)" + r"\s*".join(words)), F.lit(name)).otherwise(out)
    return out


def text_length(text: Column) -> Column:
    """Length without surrounding white space; NULL counts as empty."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))


def is_vector_page(text: Column, n_drawings: Column) -> Column:
    """Extractable text and real vector paths, as opposed to a scan."""
    return (text_length(text) > 50) & (F.coalesce(n_drawings, F.lit(0)) > 5)


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of ``word``."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))
    return (removed / F.lit(len(word))).cast("bigint")


def elevation_counts(text: Column) -> Column:
    """``struct<level_hits, score>`` of a page: the level datums, and the keyword
    density that ranks elevation sheets (all words plus ten per level datum)."""
    add = lambda up, words: reduce(lambda a, b: a + b, [occurrences(up, w) for w in words])
    others = tuple(w for w in ELEVATION_WORDS if w not in LEVEL_WORDS)
    counts = lambda up: F.struct(add(up, LEVEL_WORDS).alias("levels"), add(up, others).alias("others"))
    return bind(bind(F.upper(text), counts), lambda c: F.struct(
        c["levels"].alias("level_hits"), (11 * c["levels"] + c["others"]).alias("score")))


def dimension_pair(text: Column) -> Column:
    """First ``A x B`` in the text as ``struct<w, h>`` of doubles."""
    side = lambda t, i: bind(F.regexp_extract(t, DIMENSION_PAIR, i),
                             lambda part: F.when(part != "", mixed_fraction(part)))
    return bind(text, lambda t: F.struct(side(t, 1).alias("w"), side(t, 2).alias("h")))


def field_dimensions(text: Column, field: str) -> Column:
    """Dimensions in a labelled field such as ``Frame size: 72 1/2 x 88 1/2``."""
    return dimension_pair(F.regexp_extract(text, field, 1))


def glass_kind(text: Column) -> Column:
    """Glazing named by the TEMP and ANN tokens of a block."""
    temp, ann = text.rlike(r"\bTEMP\b"), text.rlike(r"\bANN\b")
    return (F.when(temp & ann, "mixed").when(temp, "tempered").when(ann, "annealed")
            .otherwise("unknown"))


def money(text: Column) -> Column:
    """``'1,234.50'`` -> decimal."""
    return to_number(F.replace(text, F.lit(","), F.lit("")), "decimal(18,2)")


def price_blocks(text: Column) -> Column:
    """Every price block of a page, in order, as an array of structs."""
    def fields(lines: Column) -> Column:
        # a block that matched has one figure per line, with single dashes between
        return F.struct(lines[0].alias("item"), money(lines[3]).alias("unit_price"),
                        to_number(lines[5], "int").alias("qty"), money(lines[6]).alias("line_total"))
    return F.transform(F.regexp_extract_all(text, F.lit(PRICE_BLOCK), F.lit(0)),
                       lambda block: bind(F.split(block, "\n"), fields))


def safe_id(c: Column) -> Column:
    """File-name safe form of an identifier."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_.+-]", "_")


def model_slug(c: Column) -> Column:
    """Model name as used in an artifact path."""
    return F.translate(c, "/:", "__")


def provider_name(spec: Column) -> Column:
    """``name`` of ``name:model``."""
    return F.split_part(spec, F.lit(":"), F.lit(1))


def provider_model(spec: Column, default: Column | None = None) -> Column:
    """Everything after the first colon of ``name:model``; ``default`` when empty."""
    model = F.nullif(F.regexp_extract(spec, r"^[^:]*:(.*)$", 1), F.lit(""))
    return model if default is None else F.coalesce(model, default)


def canonical_key(c: Column) -> Column:
    """Column heading without dots, blanks and ``(SF)``, upper case."""
    return F.upper(F.replace(F.translate(c, ". ", ""), F.lit("(SF)"), F.lit("")))


def canonical_cells(cells: Column) -> Column:
    """Map with canonical headings; of headings that fold together the exact one stays, else the last."""
    folded = F.transform(F.map_entries(cells), lambda e: F.struct(
        canonical_key(e["key"]).alias("key"), e["value"].alias("value"), e["key"].alias("written")))
    exact = lambda e: e["key"] == e["written"]
    # exact headings go to the end, where they are the last of their kind
    ordered = lambda f: F.concat(F.filter(f, lambda e: ~exact(e)), F.filter(f, exact))
    last = lambda o: F.filter(o, lambda e, i: ~F.exists(
        F.slice(o, i + 2, F.greatest(F.size(o) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    # most rows have no headings that fold together
    single = lambda o: F.size(F.array_distinct(F.transform(o, lambda e: e["key"]))) == F.size(o)
    kept = bind(folded, lambda f: bind(ordered(f), lambda o: F.when(single(o), o).otherwise(last(o))))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def mark_key(cells: Column) -> Column:
    """Trimmed upper-case mark of a transcript row under any of its headings."""
    pick = F.coalesce(*[F.nullif(F.try_element_at(cells, F.lit(k)), F.lit(""))
                        for k in ("#", "MARK", "mark")])
    return F.upper(F.regexp_replace(pick, r"^\s+|\s+$", ""))


DASH = "—"


def fixed(v: Column, digits: int) -> Column:
    """Fixed digits by the exact binary value, ties to even, without grouping."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", v, F.lit(pattern))


def _shown(v: Column, shown: Column) -> Column:
    number = v.try_cast("double")
    return (F.when(v.isNull() | (v.cast("string").isin("", "None")) | F.isnan(number), F.lit(DASH))
            .when(number.isNull(), v.cast("string")).otherwise(shown))


def format_number_cell(v: Column, digits: int = 3) -> Column:
    """Fixed digits; a dash for empty and NaN, other text unchanged."""
    return _shown(v, fixed(v.try_cast("double"), digits))


def format_dollar_cell(v: Column) -> Column:
    return _shown(v, F.concat(F.lit("$"), fixed(v.try_cast("double"), 3)))


def format_percent_cell(v: Column) -> Column:
    return _shown(v, F.concat(fixed(v.try_cast("double") * 100, 1), F.lit("%")))


def clip_text(c: Column, length: int) -> Column:
    """At most ``length`` characters of a message, for report cells."""
    return F.substring(c, 1, length)
