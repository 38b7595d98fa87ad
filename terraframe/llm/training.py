"""Bounded training samples and a small logistic regression for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows taken per class, and characters taken of a text: at most 2 * SAMPLE_ROWS * SAMPLE_CHARS
#: characters reach the driver, whatever the corpus holds. Of a longer text a piece at a seeded place is taken; no text is left out for its length.
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 12_000


def held_out(doc_id: Column, divisor: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, remainder: int, *, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """([(text, label)], {label: rows}) from rows that aren't held out: a seeded sample per class, and how many rows each class has.

    An id that the labels name with both labels counts for both; equal label rows count once. A null text is an empty one.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), divisor, remainder)).select("doc_id", F.col(label).alias("y")).distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    seeded = [known.filter(F.col("y") == y).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(rows) for y in (0, 1)]
    picked = F.broadcast(seeded[0].union(seeded[1]).withColumnRenamed("doc_id", "_id"))  # 2 * rows ids at most
    long = F.char_length("text")
    at = F.when(long > chars, F.pmod(F.crc32(F.col("text").cast("binary")), long - chars + 1) + 1).otherwise(1).cast("int")
    piece = F.coalesce(F.substring("text", at, F.lit(chars)), F.lit("")).alias("text")
    texts = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_id")).select("doc_id", piece, "y")
    # repeated ids in documents can't lengthen the sample; the bound holds for any table
    got = texts.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", F.crc32(F.col("text").cast("binary"))).limit(2 * rows).collect()
    return [(r["text"], r["y"]) for r in got], counts


def logistic(x, y, weight, *, ridge: float = 1e-3, steps: int = 50):
    """(coefficients, intercept) by Newton's method; ``y`` may be probabilities. Deterministic."""
    import numpy as np

    x1 = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x1.shape[1], ridge)
    penalty[-1] = 1e-9
    w, weight = np.zeros(x1.shape[1]), weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (weight * (p - y)) + penalty * w
        hessian = (x1 * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])
