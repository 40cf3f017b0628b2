"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every document is repeated a Poisson-distributed number of times whose mean is the rate of its
source: wanted share of the text volume over present share. The draw inverts the distribution
function at a number in [0, 1) made from a seeded hash of the document's id, so it is the same
whenever and wherever a task runs. Copies then go to a random place of a global order.

Defined results: a null source is a source of its own; a null text has volume 0; sources
without any text keep the rate 1; documents with a null id draw like an empty id; equal ids
draw equal counts; an empty table gives an empty mix. New columns replace old ones of that name.
The distribution function of a source is a list of about rate + 12 * sqrt(rate) + 30 numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from fenestra.llm.common import by_position, name_of, partitions
from fenestra.session import stage

#: Share of a source without a target of its own: its volume to this power.
TEMPERATURE = 0.5
SEED = 17
#: Code points in a partition of the mix, about; the session's number of partitions is the least.
PIECE = 128 << 20
_BITS = 52


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) of 52 bits, from the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("bigint") / F.lit(2.0 ** _BITS)


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE,
                 total: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, volume, rate: one row per source, from one aggregation with map-side sums.

    ``targets`` names relative weights of sources; without it a source weighs
    volume ** temperature. Sources missing in ``targets`` get no copies. ``total`` is the
    wanted volume relative to the present one.
    """
    sources = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(
        F.sum(F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).cast("bigint")).alias("volume"))
    weight = F.pow(F.col("volume").cast("double"), F.lit(temperature))
    if targets is not None:
        named = [F.when(F.col("source") == F.lit(k), F.lit(float(v))) for k, v in targets.items()]
        weight = F.coalesce(*named, F.lit(0.0))
    weighed = sources.withColumn("weight", F.when(F.col("volume") > 0, weight).otherwise(0.0))
    sums = weighed.agg(F.struct(F.sum("weight").alias("weights"), F.sum("volume").alias("volumes"))).scalar()
    rate = F.col("weight") / sums["weights"] * F.lit(total) * sums["volumes"] / F.col("volume")
    return weighed.select("source", "volume", F.when(F.col("volume") > 0, F.round(rate, 9)).otherwise(1.0).alias("rate"))


def with_distribution(rates: DataFrame) -> DataFrame:
    """Add ``cdf``: P(X <= k) for k = 0, 1, ... as far as doubles can tell it from 1."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    ks = rates.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_factorial = F.sum(F.when(F.col("k") > 0, F.ln(F.col("k").cast("double"))).otherwise(0.0)).over(upto)
    log_p = F.when(F.col("k") > 0, F.col("k") * F.ln("rate")).otherwise(0.0) - F.col("rate") - log_factorial
    p = ks.withColumn("p", F.when(F.col("rate") > 0, F.exp(log_p)).otherwise((F.col("k") == 0).cast("double")))
    summed = p.withColumn("c", F.sum("p").over(upto))
    return summed.groupBy("source", "volume", "rate").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def _pieces(rates: DataFrame) -> int:
    """Partitions of about ``PIECE`` code points for the expected volume of the mix."""
    expected = rates.agg(F.sum(F.col("volume") * F.col("rate"))).first()[0]  # one row per source was written
    return math.ceil((expected or 0) / PIECE)


def mix(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float = 1.0,
        seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with ``copy`` (from 0), ``rate`` and ``order_key``, in global random order.

    The rates are written to the shared folder first: Spark then knows their size and
    sends them to all tasks while they are few, or joins by shuffle, where a
    dominating source is split as a skewed join. The partition of a copy is computed from
    its order key, which is uniform, so no pass for range bounds is needed.
    """
    rates = stage(with_distribution(source_rates(docs, targets, temperature, total, source_col, text_col)), "rates")
    rows, names = by_position(docs)
    left = rows.join(rates, F.col(name_of(names, source_col)).eqNullSafe(F.col("source")))
    ident = F.coalesce(F.col(name_of(names, id_col)).cast("string"), F.lit(""))
    drawn = left.select(*names, "rate", "cdf", ident.alias("ident"), uniform("count", seed, ident).alias("u"))
    times = F.size(F.filter(F.col("cdf"), lambda c: c <= F.col("u")))
    counted = drawn.withColumn("times", times).where("times > 0").drop("cdf", "u")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).withColumn(
        "order_key", (uniform("order", seed, F.col("ident"), F.col("copy")) * F.lit(2.0 ** _BITS)).cast("bigint"))
    parts = max(partitions(docs), _pieces(rates))
    place = F.floor(F.col("order_key") / F.lit(2.0 ** _BITS) * parts).cast("int")
    shuffled = copies.withColumn("place", place).repartitionById(parts, "place").sortWithinPartitions("order_key")
    new = ("copy", "rate", "order_key")
    return shuffled.select(*[F.col(n).alias(c) for n, c in names.items() if c not in new], *new)
