"""Mixing sources to target weights by a min-cost flow.

A document may belong to several sources. Documents are aggregated by membership pattern (its sorted
set of sources) into token capacities; a min-cost flow routes capacity from patterns to source quotas,
where the r-th pass over a pattern costs r * r more than nothing, so that no token is repeated while
another that could serve the quota is unused. The flow is solved on the driver over patterns and sources, as both are numbers of
corpora, not of rows: the MAX_PATTERNS patterns with the most tokens go as they are; should there be more, each of the others
counts for its scarcest source alone (the one with the highest target to its size), so MAX_PATTERNS patterns and one for each source are the most that
reach the driver. No document is left out by that; only the cost may be higher than the least. What a pattern gives is then
selected from its documents: whole passes for all, and one more pass for the first ones in the order of a seeded
hash, up to the remaining tokens.

The seeded order needs a running sum of sizes. It is found in two levels: sums per pattern and hash
bucket, and an exact order within the one bucket where the quota ends. No pattern is gathered in one task.

Nulls: a null text has size 0; a null source sorts last and is a source of its own; documents without any source
(an empty or null list) are in the result but never taken, and their source size and target are null. Repeated rows are ordered by (hash, id, size)
and are interchangeable. A document of size 0 takes nothing. An empty table gives an empty result. Extra columns of any name may be
kept, in a struct ``kept``.
"""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, fresh, leave, materialise, quoted

#: Patterns that the driver's flow takes as they are.
MAX_PATTERNS = 200_000
MAX_PASSES = 3
#: Hash buckets of a pattern: its first BUCKET_DIGITS hexadecimal digits.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(order: list, by_source: dict, weights: dict, total: int, passes: int = MAX_PASSES) -> dict:
    """Each source's share of ``total`` by weight, at most ``passes`` times its size; the excess is reshared by weight."""
    left, free, out = float(total), [s for s in order if by_source[s] > 0], {s: 0.0 for s in order}
    while free:
        unit = left / sum(weights[s] for s in free)
        over = [s for s in free if unit * weights[s] > passes * by_source[s]]
        if not over:
            return out | {s: unit * weights[s] for s in free}
        for s in over:
            out[s] = float(passes * by_source[s])
            left -= out[s]
        free = [s for s in free if s not in over]
    return out


def flow(capacity: dict[int, int], members: dict[int, list[int]], quota: dict[int, int], *, passes: int = MAX_PASSES) -> dict[tuple[int, int], int]:
    """Min-cost flow: (pattern, source) -> tokens.

    Successive shortest paths. An arc from the origin to a pattern holds one capacity per pass, with cost 1, 4, 9, ...; patterns reach
    their sources free of cost. As only passes cost, a shortest path ends at the cheapest pattern that can be reached, and patterns matter to
    the search only by the sources between which they can shift tokens: it runs over sources, and only if another source's patterns are cheaper.
    """
    used = dict.fromkeys(capacity, 0)
    sent: dict[tuple[int, int], int] = {}
    # shifts[s, t]: patterns of s that give tokens to t
    shifts: dict[tuple[int, int], dict[int, None]] = {}
    need = dict(quota)

    def price(p: int) -> float:
        k = used[p] // capacity[p] if capacity[p] else passes
        return float((k + 1) ** 2) if k < passes else float("inf")

    heaps: dict[int, list] = {s: [] for s in quota}
    for p, ss in sorted(members.items()):
        for s in ss:
            heaps.setdefault(s, []).append((price(p), p))

    def best(s: int) -> tuple[float, int]:
        heap = heaps[s]
        while heap and heap[0][0] != (now := price(heap[0][1])):
            heapq.heapreplace(heap, (now, heap[0][1]))
        return heap[0] if heap else (float("inf"), -1)

    def give(p: int, s: int, amount: int) -> None:
        was = sent.get((p, s), 0)
        sent[p, s] = was + amount
        if (was == 0) != (was + amount == 0):
            for t in members[p]:
                if t != s and was == 0:
                    shifts.setdefault((t, s), {})[p] = None
                elif t != s:
                    del shifts[t, s][p]

    for heap in heaps.values():
        heapq.heapify(heap)
    for s0 in sorted(need):
        while need[s0] > 0:
            at, (low, p) = s0, best(s0)
            before: dict[int, int | None] = {s0: None}
            if low > min(best(s)[0] for s in heaps):
                queue = deque([s0])
                while queue:
                    s = queue.popleft()
                    for t in heaps:
                        if t not in before and shifts.get((s, t)):
                            before[t] = s
                            queue.append(t)
                            if best(t)[0] < low:
                                at, (low, p) = t, best(t)
            if low == float("inf"):
                break
            path, node = [], at
            while before[node] is not None:
                path.append((before[node], node, next(iter(shifts[before[node], node]))))
                node = before[node]
            amount = min([need[s0], capacity[p] - used[p] % capacity[p], *(sent[q, t] for _, t, q in path)])
            give(p, at, amount)
            for s, t, q in path:  # q gives s what it gave t
                give(q, t, -amount)
                give(q, s, amount)
            used[p] += amount
            need[s0] -= amount
    return {k: v for k, v in sent.items() if v > 0}


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, *, seed: int = 0, passes: int = MAX_PASSES, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """(id, size, sources, source_size, target, taken, passes): what the mix takes of each row of ``docs``.

    ``sources``: array of a row's sources (by default the column ``source`` alone). ``weights``: by source; by
    default 1, 2, 3, repeating over the sources in code-point order, null last. ``source_size`` and ``target`` are those of a
    row's first source; ``passes`` names, for each time a row is taken, the source it counts for.
    ``keep`` adds a struct ``kept`` of columns of ``docs`` (they are shuffled with the row).
    """
    spark = docs.sparkSession
    sources = F.array(F.col("source")) if sources is None else F.coalesce(sources, F.array().cast("array<string>"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))).cast("binary"))
    held = F.struct(*map(quoted, keep)) if keep else F.lit(None).cast("string")
    slim = docs.select(F.col(quoted(id_col)).alias("id"), word_count(F.col(quoted(text_col))).alias("size"), F.array_sort(F.array_distinct(sources)).cast("array<string>").alias("pattern"), key.alias("key"), held.alias("kept"))
    path = fresh(spark, "mix-rows")
    slim = materialise(slim, "mix-rows", path=path)
    leave(spark, path)
    bucket = F.substring("key", 1, BUCKET_DIGITS)

    patterns = slim.filter(F.size("pattern") > 0).groupBy("pattern").agg(F.sum("size").alias("size"))
    ranked = patterns.orderBy(F.desc("size"), F.col("pattern").cast("string"))
    head = [([*r["pattern"]], r["size"]) for r in ranked.limit(MAX_PATTERNS + 1).collect()]
    rank = lambda s: (s is None, (s or "").encode())
    narrowed = len(head) > MAX_PATTERNS
    if narrowed:
        path = fresh(spark, "mix-patterns")
        patterns = materialise(patterns, "mix-patterns", path=path)
        leave(spark, path)
        by_source = {r["s"]: r["n"] for r in patterns.select(F.explode("pattern").alias("s"), "size").groupBy("s").agg(F.sum("size").alias("n")).collect()}  # corpora
        total = patterns.agg(F.sum("size")).first()[0]
    else:
        by_source, total = {}, sum(n for _, n in head)  # an overlapping document counts once in what there is to share
        for pattern, n in head:
            for s in pattern:
                by_source[s] = by_source.get(s, 0) + n
    order = sorted(by_source, key=rank)
    if weights is None:
        weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    shares = targets(order, by_source, weights, total, passes)
    number = {s: i for i, s in enumerate(order)}
    routed = F.col("pattern")
    if narrowed:
        # the larger patterns as they are, each of the others as its scarcest source
        scarce = sorted(order, key=lambda s: (-shares[s] / max(1, by_source[s]), rank(s)))
        wide = F.broadcast(spark.createDataFrame([(p,) for p, _ in head[:MAX_PATTERNS]], "wide array<string>"))  # MAX_PATTERNS rows
        listed = F.array(*[F.lit(s) for s in scarce])
        only = F.array(F.filter(listed, lambda s: F.exists("pattern", lambda x: x.eqNullSafe(s)))[0])
        route = lambda df: df.join(wide, F.col("pattern") == F.col("wide"), "left").withColumn("routed", F.when(F.col("wide").isNotNull() | (F.size("pattern") == 0), F.col("pattern")).otherwise(only)).drop("wide")
        slim, patterns = route(slim), route(patterns)
        head = [([*r["routed"]], r["size"]) for r in patterns.groupBy("routed").agg(F.sum("size").alias("size")).collect()]  # MAX_PATTERNS and the number of sources
        routed = F.col("routed")
    rows = sorted(head, key=lambda x: [rank(s) for s in x[0]])
    sent = flow({k: n for k, (_, n) in enumerate(rows)}, {k: [number[s] for s in pattern] for k, (pattern, _) in enumerate(rows)}, {number[s]: int(shares[s] + 0.5) for s in order}, passes=passes)
    plan: list[tuple] = []
    for k, (pattern, n) in enumerate(rows):
        at, parts = 0, []
        for s in pattern:
            if m := sent.get((k, number[s]), 0):
                parts.append((at, at + m, s))
                at += m
        plan.append((pattern, n, parts))
    table = F.broadcast(spark.createDataFrame(plan, "routed array<string>, cap long, parts array<struct<lo:long,hi:long,source:string>>"))
    first = F.broadcast(spark.createDataFrame([(s, by_source[s], round(shares[s], 6)) for s in order], "first string, source_size long, target double"))

    placed = slim.withColumn("routed", routed).withColumn("bucket", bucket)
    sums = placed.groupBy("routed", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("routed").orderBy("bucket")) - F.col("n")).drop("n")
    # at most 16 ** BUCKET_DIGITS sums for each pattern; Spark broadcasts them only if they are small
    running = F.sum("size").over(Window.partitionBy("routed", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = placed.withColumn("in_bucket", running).join(sums, ["routed", "bucket"])
    placed = placed.join(table, "routed", "left").join(first, (F.size("pattern") > 0) & F.get("pattern", F.lit(0)).eqNullSafe(F.col("first")), "left")
    middle = F.col("before") + F.col("in_bucket") + F.col("size") / 2.0
    turns = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda r: F.filter("parts", lambda x: (r * F.col("cap") + middle >= x["lo"]) & (r * F.col("cap") + middle < x["hi"])))
    taken = F.when((F.col("size") > 0) & F.col("parts").isNotNull(), F.transform(F.flatten(turns), lambda x: x["source"])).otherwise(F.array().cast("array<string>"))
    out = placed.withColumn("passes", taken)
    return out.select(F.col("id").alias(id_col), "size", F.col("pattern").alias("sources"), "source_size", "target", (F.col("size") * F.size("passes")).alias("taken"), "passes", *(["kept"] if keep else []))
