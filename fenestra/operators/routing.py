"""Route documents to a processing branch from page-level signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fenestra.functions import text as tx
from fenestra.operators.ordered import row_numbers, top_rows
from fenestra.session import stage

# fixed values: signal limits and branch names
TEXT_PAGE_CHARS = 40
SCHEDULE_PAGE_CHARS = 200
RASTER_FRACTION = 0.15
RASTER_CHARS = 120
MIN_LEVEL_HITS = 2
_BLANKS = r"\s*"
BRANCHES = {1: "vector-table", 2: "raster-table", 3: "elevations", 4: "handwritten"}


def sample_numbers(n_pages: Column) -> Column:
    """First, middle and last page number (1-based), without repeats, in order."""
    middle = F.floor(n_pages / 2).cast("bigint") + 1
    return F.array_sort(F.array_distinct(F.array(
        F.lit(1).cast("bigint"), middle, n_pages.cast("bigint"))))


def sample_pages(pages: DataFrame, k: int = 3) -> DataFrame:
    """At most ``k`` sampled pages per document."""
    wanted = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select(
        "doc_id", F.explode(F.slice(sample_numbers(F.col("n")), 1, k)).alias("page_no"))
    return pages.join(wanted, ["doc_id", "page_no"], "left_semi")


def _splits() -> list[tuple[str, str, str]]:
    """(profile, end of one page, start of the next) for every place a page break can cut a name."""
    return [(name, rf"(?i){_BLANKS.join(words[:i])}\s*$", rf"(?i)^\s*{_BLANKS.join(words[i:])}")
            for name, words in tx.PROFILE_PATTERNS.items() for i in range(1, len(words))]


def page_signals(pages: DataFrame) -> DataFrame:
    """Light per-page figures; the only step that reads the text.

    An optional column ``scanned`` marks pages whose text was read from an image:
    they have no text layer, so they count as pages without characters.
    """
    body, chars = F.coalesce("text", F.lit("")), tx.text_length(F.col("text"))
    if "scanned" in pages.columns:
        chars = F.when(F.col("scanned"), F.lit(0).cast("int")).otherwise(chars)
    cut = {f"_{side}{i}": body.rlike(pattern) for i, (_, *patterns) in enumerate(_splits())
           for side, pattern in zip(("ends", "starts"), patterns)}
    return pages.select(
        "doc_id", "page_no", chars.alias("chars"),
        (tx.has_unit_table(body) & (chars > SCHEDULE_PAGE_CHARS)).alias("scheduled"),
        tx.detect_profile(body).alias("profile"), *[c.alias(n) for n, c in cut.items()])


def _profile_across_pages(signals: DataFrame) -> DataFrame:
    """Profile names cut by a page break: one page with text ends with the first words, the next one
    with text starts with the rest.

    Only documents with such an ending are numbered; neighbours meet in an equi-join.
    """
    found = []
    filled = signals.where("chars > 0")
    for i, (name, *_) in enumerate(_splits()):
        docs = filled.where(f"_ends{i}").select("doc_id").distinct()
        numbered = row_numbers(filled.join(docs, "doc_id", "left_semi"), ["doc_id"], [F.col("page_no")], "n",
                               bound_by=signals)
        after = numbered.where(f"_starts{i}").select("doc_id", (F.col("n") - 1).alias("n"))
        found.append(numbered.where(f"_ends{i}").join(after, ["doc_id", "n"], "left_semi").select(
            "doc_id", F.lit(name).alias("_split_profile")))
    return reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(
        F.min("_split_profile").alias("_split_profile"))


def route_signals(pages: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """One row of signals per document from ``pages(doc_id, page_no, text)``.

    ``votes(doc_id, page_no, vote)`` holds the class of scanned pages; only the
    sampled pages of near text-free documents count. Without votes such a
    document counts as handwritten.
    """
    signals = stage(page_signals(pages), "signals")
    docs = signals.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        (F.count_if(F.col("chars") > TEXT_PAGE_CHARS) / F.count(F.lit(1))).alias("vector_page_frac"),
        F.max("chars").alias("max_chars"),
        F.min(F.when(F.col("scheduled"), F.col("page_no"))).alias("_schedule_page"),
        F.max("profile").alias("_profile"))
    docs = docs.join(_profile_across_pages(signals), "doc_id", "left").withColumn(
        "notation_profile", F.coalesce("_profile", "_split_profile"))
    raster = (F.col("_schedule_page").isNull() & (F.col("vector_page_frac") < RASTER_FRACTION)
              & (F.col("max_chars") < RASTER_CHARS))
    if votes is None:
        docs = docs.withColumn("_table_page", F.lit(None).cast("bigint")).withColumn("_hand", raster)
    else:
        asked = docs.where(raster).select(
            "doc_id", F.explode(sample_numbers(F.col("n_pages"))).alias("page_no"))
        answers = asked.join(votes, ["doc_id", "page_no"]).groupBy("doc_id").agg(
            F.min(F.when(F.col("vote").startswith("TABLE"), F.col("page_no"))).alias("_table_page"),
            F.count_if(F.col("vote").startswith("HAND")).alias("_hands"))
        docs = docs.join(answers, "doc_id", "left").withColumn(
            "_hand", F.col("_table_page").isNull() & (F.coalesce("_hands", F.lit(0)) > 0))
    page = F.coalesce("_schedule_page", "_table_page")
    return docs.select(
        "doc_id", "n_pages", "vector_page_frac", page.isNotNull().alias("has_schedule_sheet"),
        F.col("_schedule_page").isNotNull().alias("schedule_is_vector"),
        F.col("_hand").alias("is_handwritten"), "notation_profile",
        (page - 1).cast("bigint").alias("schedule_page_index"))


def classify(signals: DataFrame) -> DataFrame:
    """Add ``branch`` and ``branch_name``; the most specific signal decides."""
    branch = (F.when(F.col("is_handwritten"), 4)
              .when(F.col("has_schedule_sheet") & F.col("schedule_is_vector"), 1)
              .when(F.col("has_schedule_sheet"), 2).otherwise(3))
    names = F.create_map(*[F.lit(x) for kv in BRANCHES.items() for x in kv])
    return signals.withColumn("branch", branch).withColumn("branch_name", names[F.col("branch")])


def elevation_pages(pages: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` densest elevation sheets per document, ranked."""
    # counted and filtered in one generator: a filter alone would be pushed down and count twice
    dense = F.filter(F.array(tx.elevation_counts(F.col("text"))), lambda c: c["level_hits"] >= MIN_LEVEL_HITS)
    scored = pages.select(*[c for c in pages.columns if c != "text"], F.inline(dense))
    return top_rows(scored, ["doc_id"], [F.col("score").desc(), F.col("page_no").asc()], k)
