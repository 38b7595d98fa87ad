"""Helpers shared by the training-data operators.

* ``materialise`` cuts lineage with a Parquet table in the shared folder named by
  ``spark.checkpoint.dir``; every executor can reread it, so a lost executor costs
  a retry, never a result.
* ``attach`` is the one join used wherever a key may hold a large part of the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.files import shared

#: Separators of words: space and the ASCII controls 0x09 to 0x0D.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"
#: After the HOT_KEYS most frequent keys are taken out, no key holds more than
#: 1 / (HOT_KEYS + 1) of the rows, whatever the data.
HOT_KEYS = 1000
#: Rows and bytes in an Arrow batch sent to Python; with texts the bytes rule.
ARROW_ROWS = 10_000
ARROW_BYTES = 4 << 20

#: While a table is written: shuffle files go when the query ends; joins whose build side is small in every partition (as measured once it is
#: shuffled) need no sort; runs that lie sorted in one file a bucket aren't sorted again.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, see ``files.shared``."""
    return shared(spark)


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def writing(spark: SparkSession, more: dict[str, str] | None = None) -> Iterator[None]:
    """Settings for a write; those of the session come back afterwards."""
    settings = _WRITING | (more or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str, *, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = path or fresh(spark, name)
    with writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later query reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Tables in the shared folder that a result not yet computed may read, by application.
_LEFT: dict[str, list[str]] = {}


def leave(spark: SparkSession, path: str) -> None:
    """Note a path that a returned DataFrame reads, for ``cleanup``."""
    _LEFT.setdefault(spark.sparkContext.applicationId, []).append(path)


def cleanup(spark: SparkSession) -> None:
    """Delete what earlier operators left for results that have been written or are no longer wanted."""
    for path in _LEFT.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free(columns: list[str], name: str) -> str:
    """A name like ``name`` that no column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def arrow_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Keep the session's batches for Python small: texts differ in length by orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def lean(work):
    """``work`` on batches, after which its worker gives freed memory back: Spark keeps idle workers beside the next stage's."""

    def run(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # not this C library

    return run


def put(path: str, data: bytes) -> None:
    """Write a file of the shared folder from a task; it appears whole, and a repeated task replaces it by the same."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    draft = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft, compression=None) as out:
        out.write(data)
    store.move(draft, at)


def mapped(path: str):
    """A file of the shared folder as a buffer, mapped into memory where the folder is mounted; None if there is no such file."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    if store.type_name == "local":
        import mmap

        with open(at, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with store.open_input_file(at) as f:
        return f.read()


def attach(rows: DataFrame, groups: DataFrame, key: str, weight: str, values: list[str], spread: Column) -> DataFrame:
    """Left join of ``rows`` to ``groups`` (one row per key) that no hot key can unbalance.

    ``groups[weight]`` counts the rows of a key. The HOT_KEYS heaviest keys go by a broadcast of at most
    HOT_KEYS rows; their rows carry a salt in the shuffle join and so spread evenly. What remains is
    balanced by pigeonhole. ``spread`` is any column that differs between rows of one key.
    """
    table = groups.select(F.col(key).alias("_gk"), F.struct(*values).alias("_gv"), F.col(weight).alias("_gn"))
    hot = table.orderBy(F.desc("_gn"), "_gk").limit(HOT_KEYS).select(F.col("_gk").alias("_hk"), F.col("_gv").alias("_hv"))
    # zero, but not a literal: that would be folded into a condition, and rows then dealt out by the key alone
    cold = table.select("_gk", "_gv", F.least(F.lit(0).cast("long"), F.col("_gn").cast("long")).cast("int").alias("_gs"))
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    left = left.withColumn("_s", F.when(F.col("_hk").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int") + 1).otherwise(0))
    out = left.join(cold, (F.col(key) == F.col("_gk")) & (F.col("_s") == F.col("_gs")), "left")
    picked = F.coalesce("_hv", "_gv")
    return out.select(*[F.col(c) for c in rows.columns], *[picked[v].alias(v) for v in values])


def connected_components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, component) for undirected links (u, v): component is the smallest node reachable.

    Alternates large-star and small-star until the links stop changing; each step is a partial
    aggregate plus an ``attach``, so a hub with any number of links stays spread. Nodes without a
    link to another node aren't in the result; nulls and loops are ignored.
    """
    spark = edges.sparkSession

    def stars(links: DataFrame, large: bool) -> DataFrame:
        # u >= v in links; large-star looks at all neighbours, small-star at the smaller ones
        flat = links.select("u", "v").union(links.select(F.col("v"), F.col("u"))) if large else links
        low = flat.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("u", F.least("u", "low").alias("low"), "n")
        with_low = attach(flat, low, "u", "n", ["low"], F.col("v"))
        if large:
            moved = with_low.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        else:
            moved = with_low.filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
        return moved.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    path = fresh(spark, "links")
    links = materialise(edges.filter("u != v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), "links", path=path)
    was = mark(links)
    for _ in range(rounds):
        old, path = path, fresh(spark, "links")
        links = materialise(stars(stars(links, True), False), "links", path=path)
        remove(spark, old)
        now = mark(links)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    leave(spark, path)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
