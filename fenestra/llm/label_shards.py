"""Sharding by balanced label propagation, with DataFrame functions only.

Documents with an equal link value (by default the whole text) are neighbours. A document's label
is its shard. In every round the linked documents of a group move towards the shard that holds
most of their neighbours, as far as the quotas of the shards allow; a group larger than a
shard fills one shard after another. Unlinked documents cut no edge wherever they are, so
they make up the balance: at the end the row counts of the shards differ by one at most.

Documents of one group that sit in the same shard are interchangeable, so the rounds run on
(group, shard, rows) counts, not on documents: a group that holds a third of all rows is as
many rows there as it has shards. The documents get their shard once, after the last round.

Defined results: a null text is a link of its own kind, apart from the empty text; a null id sorts
first; equal rows get places next to each other; an empty table gives no rows. ``size`` is the
UTF-8 bytes of the text (null: none) plus 8.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from fenestra.session import stage

ROUNDS = 8
#: Rows that one bucket of a shard should have on average; sets the number of buckets.
BUCKET_ROWS = 50_000
#: Extra room of a shard in the first round, as a share of its quota; halved from round to round. It lets groups change
#: places where all shards are full of linked documents.
SLACK = 0.5
#: Groups are let in by falling gain, in this many hashed parts per gain class.
_PARTS = 256


def _rank(counts: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of a group; for tables of bounded groups."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def propagate(groups: DataFrame, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """Move rows of ``groups`` (g, shard, n) between shards; same columns, same totals by g.

    ``quota`` is the number of linked rows that a shard should hold; ``SLACK`` lets it have more at first.
    """
    state = stage(groups, "labels")
    for turn in range(rounds):
        most = int(quota * (1 + SLACK * 0.5 ** turn))
        loads = state.groupBy("shard").agg(F.sum("n").alias("load"))
        room = {r["shard"]: most - r["load"] for r in loads.collect()}  # one row per shard
        free = F.lit(most)
        for shard, left in room.items():
            free = F.when(F.col("shard") == shard, F.lit(left)).otherwise(free)
        # the neighbours' favourite shard among those with room left
        favourite = state.withColumn("_free", free).groupBy("g").agg(
            F.max(F.when(F.col("_free") > 0, F.struct("n", (-F.col("shard")).alias("_s")))).alias("_f")).select(
            "g", F.col("_f.n").alias("held"), (-F.col("_f._s")).alias("to"))
        # rows in a full shard stay if more neighbours are there than in the favourite
        wishes = state.join(favourite, "g").where("to is not null and shard != to and n <= held").withColumn(
            "gain", F.floor(F.log2(F.col("held") + 1)).cast("int")).withColumn(
            "part", F.pmod(F.xxhash64("g", F.lit(turn)), F.lit(_PARTS)).cast("int"))
        # let in part by part; the part at the edge of the room gets in by share
        asked = _rank(wishes.groupBy("to", "gain", "part").agg(F.sum("n").alias("rows")).withColumn(
            "_first", -F.col("gain")), ["to"], ["_first", "part"], "rows", "before")
        room_of = F.lit(most)
        for shard, left in room.items():
            room_of = F.when(F.col("to") == shard, F.lit(left)).otherwise(room_of)
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (room_of - F.col("before")) / F.col("rows")))
        let_in = asked.select("to", "gain", "part", share.alias("share")).where("share > 0")
        moves = wishes.join(let_in, ["to", "gain", "part"]).withColumn(
            "m", F.floor(F.col("n") * F.col("share")).cast("bigint")).where("m > 0")
        moves = stage(moves.select("g", "shard", "to", "m"), "moves")
        if moves.isEmpty():
            return state
        changed = state.unionByName(moves.select("g", "shard", (-F.col("m")).alias("n"))).unionByName(
            moves.select("g", F.col("to").alias("shard"), F.col("m").alias("n")))
        state = stage(changed.groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "labels")
    return state


def _seeded(linked: DataFrame, first: DataFrame, quota: int, shards: int) -> DataFrame:
    """First labels in which a group of more than half a shard starts in as few shards as it needs.

    There are at most two such groups to a shard, so their names and sizes come to the driver.
    """
    large = linked.where(F.col("members") * 2 > quota).select("g", "members").distinct()
    room, rows = [quota] * shards, []
    for r in sorted(large.collect(), key=lambda r: (-r["members"], r["g"])):
        left = r["members"]
        while left:
            to = max(range(shards), key=lambda s: (room[s], -s))
            n = min(left, room[to]) or left  # what fits nowhere is dealt with at the end
            rows.append((r["g"], to, n))
            room[to] -= n
            left -= n
    if not rows:
        return first
    seeds = first.sparkSession.createDataFrame(rows, first.schema).groupBy("g", "shard").agg(F.sum("n").alias("n"))
    return first.join(large, "g", "left_anti").unionByName(seeds)


def cut_edges(placed: DataFrame) -> DataFrame:
    """Linked groups, shards they touch beyond the first, and rows: what propagation keeps small."""
    spread = placed.groupBy("link").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("shard").alias("shards"))
    return spread.where("rows > 1").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("shards") - 1).alias("cuts"),
                                        F.sum("rows").alias("rows"))


def shard(docs: DataFrame, shards: int, rounds: int = ROUNDS, link: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, link, shard, slot of every document; slots count from 0 in each shard."""
    text = F.col(f"`{text_col}`")
    link = F.coalesce(F.sha2(text, 256), F.lit("")) if link is None else link
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
                       F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"), link.alias("g"))
    total = docs.count()
    buckets = shards * max(16, -(-total // (shards * BUCKET_ROWS)))
    rows = stage(rows.withColumn("b", F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int")), "rows")

    # members of each group by bucket, and their place in the group; a bucket belongs to a first shard
    pieces = rows.groupBy("g", "b").agg(F.count(F.lit(1)).alias("c"))
    pieces = _rank(pieces, ["g"], ["b"], "c", "before").withColumn("members", F.sum("c").over(Window.partitionBy("g")))
    pieces = stage(pieces, "pieces")
    linked = pieces.where("members > 1")
    first = linked.groupBy("g", F.pmod("b", F.lit(shards)).alias("shard")).agg(F.sum("c").alias("n"))
    labels = propagate(_seeded(linked, first, total // shards, shards), total // shards, rounds)
    ends = _rank(labels, ["g"], ["shard"], "n", "start").withColumn("end", F.col("start") + F.col("n"))
    ends = ends.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    pieces = pieces.join(ends, "g", "left")

    inside = F.row_number().over(Window.partitionBy("g", "b").orderBy("_id", "size")) - 1
    rank = F.col("before") + F.col("_n")
    own = F.filter("ends", lambda e: e["end"] > rank)
    label = F.when(F.col("ends").isNull(), F.pmod("b", F.lit(shards))).otherwise(F.get(own, F.lit(0))["shard"])
    placed = rows.withColumn("_n", inside).join(pieces.select("g", "b", "before", "members", "ends"), ["g", "b"])
    # rows of large groups come first in a shard, single ones last
    group_size = F.floor(F.log2(F.col("members"))).cast("int")
    placed = stage(placed.select("_id", "size", "text_crc32", "g", "b", label.cast("int").alias("label"),
                                 (-group_size).alias("small")), "placed")

    # number the rows of a shard; what exceeds the quota fills the others
    parts = placed.groupBy("label", "small", "b").agg(F.count(F.lit(1)).alias("c"))
    parts = stage(_rank(parts, ["label"], ["small", "b"], "c", "ahead"), "parts")
    loads = [0] * shards
    for r in parts.groupBy("label").agg(F.sum("c").alias("n")).collect():  # one row per shard
        loads[r["label"]] = r["n"]
    quotas = [total // shards + (i < total % shards) for i in range(shards)]
    surplus = [max(0, n - q) for n, q in zip(loads, quotas)]
    deficit = [max(0, q - n) for n, q in zip(loads, quotas)]
    numbers = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    at = lambda values, i: F.get(numbers(values), i)
    before_surplus, before_deficit = [0, *accumulate(surplus)][:-1], list(accumulate(deficit))
    position = F.col("ahead") + F.row_number().over(Window.partitionBy("label", "small", "b").orderBy("_id", "g")) - 1
    numbered = placed.join(parts.select("label", "small", "b", "ahead"), ["label", "small", "b"]).withColumn(
        "_p", position)
    over = F.col("_p") - at(quotas, F.col("label"))
    spare = at(before_surplus, F.col("label")) + over
    target = F.size(F.filter(numbers(before_deficit), lambda e: e <= F.col("_e")))
    numbered = numbered.withColumn("_e", F.when(over >= 0, spare)).withColumn(
        "shard", F.when(F.col("_e").isNull(), F.col("label")).otherwise(target))
    start = at(before_deficit, F.col("shard")) - at(deficit, F.col("shard"))
    slot = F.when(F.col("_e").isNull(), F.col("_p")).otherwise(at(loads, F.col("shard")) + F.col("_e") - start)
    return numbered.select(F.col("_id").alias(id_col), "size", "text_crc32", F.col("g").alias("link"),
                           F.col("shard").cast("int").alias("shard"), slot.cast("bigint").alias("slot"))
