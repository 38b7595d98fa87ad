"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of RING positions; a row's key hashes to a position, and
the row goes to the first shard clockwise that isn't full. Capacities are the even shares, so counts
differ by one at most (law ``rows``); rows beyond a full shard continue clockwise. That exactness has a price: there is no slack in the capacities, so a
shard more moves not only what it takes (1 / 17 of the rows when the 17th comes) but also what overflows: 13 to 14 % of the rows move then. With a fresh deal
to other shards 94 % would.

The rows are counted per ring position (at most RING counts), one fold over the arcs of the ring
(at most shards * vnodes of them) says which ranks of an arc go where, and each row finds its rank
within its own position. Only slim columns are shuffled, never texts. All of it is SQL expressions. A position with very many rows, as of one
repeated id, is ranked in SUBS parts, and rows that are equal in all that counts are one row with a number until the last step.

Nulls: a null text has no bytes (size 1, crc of the empty string); a row with a null id is placed by
its text's checksum and size. Rows that are equal in id, size and checksum are interchangeable. An
empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import quoted

#: Positions of the ring, and parts in which the rows of a position are ranked.
RING = 1 << 16
SUBS = 256


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise; a position taken by two goes to the lower shard."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            p = int.from_bytes(hashlib.sha256(f"{s}#{v}".encode()).digest()[:8], "big") % RING
            at[p] = min(s, at.get(p, s))
    return sorted(at.items())


def preference(nodes: list[tuple[int, int]], k: int) -> list[int]:
    """The shards met clockwise from virtual node k, each once."""
    return list(dict.fromkeys(s for _, s in nodes[k:] + nodes[:k]))


def sizes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def assign(docs: DataFrame, *, shards: int = 16, vnodes: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``."""
    spark = docs.sparkSession
    nodes = ring(shards, vnodes)
    text = F.col(quoted(text_col))
    slim = docs.select(F.col(quoted(id_col)).alias("id"), sizes(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"))
    slim = slim.withColumn("h", F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("crc", "size"))).withColumn("pos", F.pmod("h", F.lit(RING)).cast("int"))
    # rows of a position are ordered by a hash of all that tells them apart; equal rows of one input partition are one row with a number
    slim = slim.withColumn("k", F.xxhash64("id", "crc", "size")).withColumn("sub", F.pmod("k", F.lit(SUBS)).cast("int")).withColumn("part", F.spark_partition_id())
    groups = slim.groupBy("pos", "sub", "k", "id", "crc", "size", "part").agg(F.count("*").alias("m"))
    subs = slim.groupBy("pos", "sub").agg(F.count("*").alias("m"))
    subs = subs.select("pos", "sub", (F.sum("m").over(Window.partitionBy("pos").orderBy("sub")) - F.col("m")).alias("first"))

    counts = slim.groupBy("pos").agg(F.count("*").alias("n"))
    # the arc of a position: the first virtual node at or after it, wrapping to the first one
    points = F.array(*[F.lit(p) for p, _ in nodes])
    arc = F.pmod(F.size(F.filter(points, lambda p: p < F.col("pos"))), F.lit(len(nodes)))
    # rows of an arc are ranked by position; positions past the last virtual node belong to arc 0 and come first
    start = F.when(F.col("pos") > nodes[-1][0], F.col("pos") - RING).otherwise(F.col("pos"))
    in_arc = Window.partitionBy("arc").orderBy("start")
    counts = counts.withColumn("arc", arc).withColumn("start", start).withColumn("before", F.sum("n").over(in_arc) - F.col("n"))
    arcs = counts.groupBy("arc").agg(F.sum("n").alias("m"))

    # one row: the arcs in ring order, folded into segments (arc, from rank, to rank, shard, first slot)
    prefs = F.array(*[F.array(*[F.lit(s) for s in preference(nodes, k)]) for k in range(len(nodes))])
    every = arcs.agg(F.sort_array(F.collect_list(F.struct("arc", "m"))).alias("arcs"), F.coalesce(F.sum("m"), F.lit(0)).alias("total"))
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.expr(f"total div {shards}") + (s < F.expr(f"total % {shards}")).cast("long"))
    every = every.withColumn("room", room)
    segment = "array<struct<arc:int,lo:bigint,hi:bigint,shard:int,slot:bigint>>"

    def place(acc: Column, a: Column) -> Column:
        def offer(inner: Column, s: Column) -> Column:
            free = F.element_at(inner["left"], s + 1)
            take = F.least(inner["m"], free)
            cap = F.element_at(F.col("room"), s + 1)
            seg = F.when(take > 0, F.array(F.struct(a["arc"].alias("arc"), inner["at"].alias("lo"), (inner["at"] + take).alias("hi"), s.alias("shard"), (cap - free).alias("slot")))).otherwise(F.array().cast(segment))
            left = F.when(take > 0, F.transform(inner["left"], lambda x, i: F.when(i == s, x - take).otherwise(x))).otherwise(inner["left"])
            return F.struct(left.alias("left"), (inner["m"] - take).alias("m"), (inner["at"] + take).alias("at"), F.concat(inner["segs"], seg).alias("segs"))

        begin = F.struct(acc["left"].alias("left"), a["m"].alias("m"), F.lit(0).cast("long").alias("at"), F.array().cast(segment).alias("segs"))
        done = F.aggregate(F.element_at(prefs, a["arc"] + 1), begin, offer)
        # the row of an arc is made once: aggregate's lambda variable holds it
        return F.aggregate(F.array(done), acc, lambda x, d: F.struct(d["left"].alias("left"), F.concat(x["segs"], d["segs"]).alias("segs")))

    folded = every.select(F.aggregate("arcs", F.struct(F.col("room").alias("left"), F.array().cast(segment).alias("segs")), place)["segs"].alias("segs"))
    segs = folded.select(F.explode("segs").alias("s")).select("s.*").groupBy("arc").agg(F.collect_list(F.struct("lo", "hi", "shard", "slot")).alias("segs"))
    # at most RING rows, each with the few segments of its arc: a bounded broadcast
    places = counts.join(F.broadcast(segs), "arc").select("pos", "before", F.expr("filter(segs, s -> s.hi > before AND s.lo < before + n)").alias("segs"))

    order = Window.partitionBy("pos", "sub").orderBy("k", "id", "crc", "size", "part").rowsBetween(Window.unboundedPreceding, 0)
    ranked = groups.withColumn("in_sub", F.sum("m").over(order) - F.col("m")).join(subs, ["pos", "sub"]).join(F.broadcast(places), "pos")
    # equal rows become rows again, spread by the partitions that they came from
    ranked = ranked.repartition(F.col("k"), F.col("part")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("first") + F.col("in_sub") + F.col("i") - 1)
    hit = F.expr("filter(segs, s -> rank >= s.lo AND rank < s.hi)[0]")
    out = ranked.withColumn("hit", hit)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("hit.shard").alias("shard"), (F.col("hit.slot") + F.col("rank") - F.col("hit.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
