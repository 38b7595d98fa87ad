"""SimHash near-duplicates by segment popcounts.

A document's fingerprint has bit b set if over half of its shingles' XXH64 values have it. Equal
fingerprints form one class. A class is embedded as the popcounts of SEGMENTS four-bit segments; the
Manhattan distance of two embeddings is a lower bound of the Hamming distance, so fingerprints within
two bits lie within Manhattan distance two. The grid range-join finds them without pairs: points within
distance two on an integer grid have a common point within distance one of both, so each class posts to its
own cell and the cells next to it, and a class is a candidate if a cell holds another class too.

Candidates are verified exactly: in cells of up to SMALL fingerprints each with each, by one expression over the cell; fingerprints of larger
cells through their one-bit neighbours, as two differ by at most two bits if and only if they share a value within one bit of both. At most 65
fingerprints are within one bit of a given value, so those groups are bounded by construction. Either way no pairs are emitted but links.
The grid's cells tell fingerprints apart up to some 10 ** 8 of them; beyond that most cells are crowded, and the neighbours do the work: 65 rows each.

Nulls: a null or wordless text has fingerprint zero and is linked like any other. A row with a null id
keeps its fingerprint and links like any other; its component is null if no row of the component has an id. Rows that
repeat an id, with one text or several, are rows of their own. Fewer words than ``shingle``: the whole sequence is the only shingle. The bits of
very long texts are counted in blocks. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from .common import arrow_batches, attach, connected_components, fresh, lean, leave, materialise, quoted

BITS = 64
SEGMENT_BITS = 4
SEGMENTS = BITS // SEGMENT_BITS
SEED = 42
#: Fingerprints of a cell that are compared each with each.
SMALL = 32
#: Hashes whose bits are counted at once, to bound memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = [0, *ends[: -shingle].tolist()], (ends[shingle - 1 :] - 1).tolist()
    counts, total = np.zeros(BITS, np.int64), len(stops)
    for at in range(0, total, BLOCK):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint of every row, as a signed 64-bit value."""
    arrow_batches(docs.sparkSession)

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([f - (1 << BITS) if f >> 63 else f for f in fps], pa.int64())], names=["id", "fp"])

    slim = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return slim.mapInArrow(lean(hashed), StructType([slim.schema["id"]]).add("fp", LongType()))


def grid_cells(fp: Column) -> tuple[Column, Column]:
    """(cells, own): the class's own cell and, from a column named own, the cells at Manhattan distance zero and one.

    Each popcount (0 to 4, one added so that steps stay positive) takes three bits of the number.
    """
    own = F.lit(0).cast("long")
    for s in range(SEGMENTS):
        part = F.shiftrightunsigned(fp, s * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1).cast("long"))
        own = own + F.shiftleft(F.bit_count(part).cast("long") + 1, 3 * s)
    steps = [0, *(d << (3 * s) for s in range(SEGMENTS) for d in (1, -1))]
    return F.transform(F.array(*[F.lit(x).cast("long") for x in steps]), lambda x: F.col("own") + x), own


def midpoints(fp: Column) -> Column:
    """All values within one bit of a fingerprint."""
    masks = [0, *((1 << b) - (1 << BITS if b == BITS - 1 else 0) for b in range(BITS))]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: fp.bitwiseXOR(m))


def link(classes: DataFrame, *, small: int = SMALL) -> DataFrame:
    """Links (u, v) between fingerprints (column fp, each once) that differ by one or two bits, enough to connect them all."""
    cell, own = grid_cells(F.col("fp"))
    posted = classes.select("fp", own.alias("own")).select("fp", F.explode(cell).alias("cell"))
    shared = posted.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).filter("n > 1")
    path = fresh(classes.sparkSession, "cells")
    shared = materialise(shared, "cells", path=path)
    leave(classes.sparkSession, path)
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= 2
    # cells of two are verified where they are
    pairs = shared.filter((F.col("n") == 2) & near(F.col("low"), F.col("high"))).select(F.col("high").alias("u"), F.col("low").alias("v"))
    held = attach(posted, shared.filter("n > 2").select("cell", "n"), "cell", "n", ["n"], F.col("fp")).filter("n IS NOT NULL")
    # cells of a few: pair by pair in one expression over at most ``small`` values
    few = held.filter(F.col("n") <= small).groupBy("cell").agg(F.collect_list("fp").alias("fps"))
    others = F.transform("fps", lambda a: F.struct(a.alias("u"), F.filter("fps", lambda b: (b < a) & near(a, b)).alias("vs")))
    pairs = pairs.union(few.select(F.explode(others).alias("x")).select(F.col("x.u").alias("u"), F.explode("x.vs").alias("v")))
    # crowded cells: through a shared value within one bit of both, of which at most 65 fingerprints are
    at = held.filter(F.col("n") > small).select("fp").distinct().select("fp", F.explode(midpoints(F.col("fp"))).alias("mid"))
    stars = at.groupBy("mid").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1").select(F.explode("fps").alias("u"), F.array_min("fps").alias("v"))
    return pairs.union(stars.filter("u > v")).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint 16 hex digits, component_id), one row per row of ``docs``; links are fingerprints within two bits."""
    spark = docs.sparkSession
    path = fresh(spark, "fingerprints")
    fps = materialise(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints", path=path)
    leave(spark, path)
    classes = fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    path = fresh(spark, "classes")
    classes = materialise(classes, "classes", path=path)
    comps = connected_components(link(classes.select("fp")))
    placed = classes.join(comps, classes.fp == comps.node, "left").withColumn("component", F.coalesce("component", "fp"))
    # the smallest id of each component
    first = comps.withColumnRenamed("node", "fp").join(classes, "fp").groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("m"))
    placed = attach(placed, first, "component", "m", ["component_id", "m"], F.col("fp"))
    placed = placed.select("fp", "n", F.when(F.col("m").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))
    out = attach(fps, placed, "fp", "n", ["component_id"], F.col("id"))
    leave(spark, path)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
