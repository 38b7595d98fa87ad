"""Viewport reads: a byte-budgeted cache, and one request at a time per viewport.

The cache and the coordinator serve one driver. Their declarative forms, for logs of requests, are DataFrame operators.
"""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


#: Spans of time over which uses are summed first.
SPANS = 1024


class ByteCache:
    """Least recently used first out, by bytes. A value larger than the budget isn't stored, and its key's old value goes."""

    def __init__(self, max_bytes: int) -> None:
        if max_bytes <= 0:
            raise ValueError("the budget must be positive")
        self.max_bytes, self.size = max_bytes, 0
        self._held: OrderedDict[Hashable, tuple[object, int]] = OrderedDict()
        self._lock = threading.Lock()

    def get(self, key: Hashable):
        with self._lock:
            if key not in self._held:
                return None
            self._held.move_to_end(key)
            return self._held[key][0]

    def set(self, key: Hashable, value, size: int) -> None:
        with self._lock:
            if key in self._held:
                self.size -= self._held.pop(key)[1]
            if size > self.max_bytes:
                return
            self._held[key] = (value, size)
            self.size += size
            while self.size > self.max_bytes:
                self.size -= self._held.popitem(last=False)[1][1]

    def clear(self) -> None:
        with self._lock:
            self._held.clear()
            self.size = 0

    def __contains__(self, key: Hashable) -> bool:
        return key in self._held


class Superseded(Exception):
    """A newer request for the viewport has begun."""


class Latest:
    """Runs requests so that a new one cancels the one before it: its Spark jobs by their tag, its result by its number."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark, self._lock, self._number, self._tag = spark, threading.Lock(), 0, None

    def run(self, work: Callable[[Callable[[], bool]], object]):
        """``work`` gets a function that says whether it is still the latest. Raises Superseded if it isn't when it ends."""
        tag = f"viewport-{uuid.uuid4().hex}"
        with self._lock:
            old, self._tag = self._tag, tag
            self._number += 1
            mine = self._number
        if old and self.spark is not None:
            self.spark.sparkContext.cancelJobsWithTag(old)
        if self.spark is not None:
            self.spark.sparkContext.addJobTag(tag)
        current = lambda: self._number == mine
        try:
            out = work(current)
        except Exception as error:
            if not current():
                raise Superseded from error
            raise
        finally:
            if self.spark is not None:
                self.spark.sparkContext.removeJobTag(tag)
        if not current():
            raise Superseded
        return out

    def cancel(self) -> None:
        with self._lock:
            self._number += 1
            old, self._tag = self._tag, None
        if old and self.spark is not None:
            self.spark.sparkContext.cancelJobsWithTag(old)


class ViewportReader:
    """Reads windows of rasters through a cache. The key holds the unclipped request and the full path; files that change aren't noticed."""

    def __init__(self, read: Callable, cache: ByteCache, spark: SparkSession | None = None) -> None:
        import inspect

        self.read, self.cache, self.latest, self.reads = read, cache, Latest(spark), 0
        # a reader with a sixth parameter can ask, as it reads, whether it is still the latest
        self.asks = len(inspect.signature(read).parameters) > 5

    def read_latest(self, path: str, layer: str, window: tuple[int, int, int, int], out_w: int, out_h: int) -> bytes:
        key = (path, layer, -1, window, out_w, out_h)

        def work(current: Callable[[], bool]) -> bytes:
            found = self.cache.get(key)
            if found is None:
                self.reads += 1
                found = self.read(path, layer, window, out_w, out_h, current) if self.asks else self.read(path, layer, window, out_w, out_h)
                if current():
                    self.cache.set(key, found, len(found))
            return found

        return self.latest.run(work)


def lru_residency(log: DataFrame, budget: int, key: str = "key", seq: str = "seq", size: str = "bytes") -> DataFrame:
    """Keys that a byte budget still holds after a log of uses of fixed-size entries: the most recent ones whose sizes fit.

    The running sum is over one row per key, summed first by the key. Sequence numbers are whole numbers or others that have differences.
    """
    last = log.groupBy(key).agg(F.max(seq).alias("last_use"), F.max_by(size, seq).alias("bytes")).filter(F.col("bytes") <= budget)
    low, high = log.agg(F.min(seq), F.max(seq)).first()
    if low is None:
        return last.select(key, "last_use", "bytes")
    # the running sum in two levels: over the spans of time, of which there are SPANS, and within each
    span = F.floor((F.lit(high) - F.col("last_use")) / F.lit(max(1.0, (high - low + 1) / SPANS)))
    last = last.withColumn("span", span)
    sums = last.groupBy("span").agg(F.sum("bytes").alias("n"))
    sums = sums.select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("before")).filter(F.col("before") <= budget)
    used = F.sum("bytes").over(Window.partitionBy("span").orderBy(F.desc("last_use")).rowsBetween(Window.unboundedPreceding, 0))
    near = last.join(F.broadcast(sums), "span").withColumn("used", F.col("before") + used)
    return near.filter(F.col("used") <= budget).select(key, "last_use", "bytes")


def latest_request(log: DataFrame, viewport: str = "viewport", seq: str = "seq", request: str = "request") -> DataFrame:
    """Per viewport the request that no later one supersedes."""
    return log.groupBy(viewport).agg(F.max(seq).alias(seq), F.max_by(request, seq).alias(request))
