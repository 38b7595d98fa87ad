"""Substring deduplication with a log-structured fingerprint index.

A window is WINDOW consecutive words. A word is removed if a window that covers it has the same words as one that
starts earlier: in a smaller id, earlier in the same text, or in anything an earlier batch brought. Texts arrive in batches. The index is a log of
immutable runs in a folder, each sorted and bucketed by key: digests of whole texts, anchors, and hashes of windows. A batch is
merge-joined with every run, and what it brings becomes another run; FAN_OUT runs of one tier are merged into a run of the next.
The folder holds a manifest, so a later session opens the index and goes on (``Index.open``); a batch that fails leaves the manifest as it was.

Hashing every window would make the index larger than the corpus, so windows are found by anchors: of the hashes of
ANCHOR-word sequences in a window, the least. Equal windows have equal anchors, and neighbours mostly share theirs, so there is
one anchor for about eight words. A window whose anchor occurs nowhere else can't have a copy. When an anchor occurs a second time, the windows around both
its occurrences are hashed from their words themselves (128 bits, so that a hit of anchors is verified by the words), and kept in the
index; from then on the runs hold all windows of that anchor. So no window is missed, and only windows near a repeat are ever shuffled.
For the first occurrence the index keeps the texts, compressed and bucketed by row number: only those that hold such an anchor are
unpacked. Texts are shuffled once, when they are stored.

Texts with equal words are one text for the index: all but the one with the smallest id are removed as a whole, if they hold a window at all.

Nulls: a null text has no words; a null id comes last. Texts shorter than a window keep everything. Rows that share an id are
separate rows, and of equal windows that start at the same id and word none is earlier, unless an earlier batch brought one. Ids may be of any
type that has an order. Very long texts are hashed in numpy arrays of a few bytes a word. An empty table gives an empty result. Extra columns are
kept with ``texts``, except those named like the three results; ``into`` gives these in one struct of a name of your own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_batches, attach, fresh, lean, leave, materialise, put, quoted, remove, writing

WINDOW = 20
ANCHOR = 6
#: Runs of one tier that are merged into one of the next.
FAN_OUT = 2
#: Batches in which ``deduplicate`` ingests a table.
BATCHES = 2
#: Bytes of texts, compressed, that a task unpacks together.
BATCH_BYTES = 1 << 20
#: A run has a file for each bucket; being a part of the corpus in slim rows, it gets this fraction of the session's partitions as buckets.
SHARE = 4
_PARTITIONS = "spark.sql.shuffle.partitions"
#: A row's number holds its batch above these bits.
BATCH_BITS = 53
RESULTS = ("n_words", "n_removed", "kept_sha256")
_M1, _MIX = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD


def word_hashes(words: list[bytes]):
    import numpy as np
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def rolled(h, size: int, factor: int):
    """Hashes of all sequences of ``size`` words, mixed so that their order is random."""
    import numpy as np

    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            out = out * np.uint64(factor) + h[j : len(h) - size + 1 + j]
        out ^= out >> np.uint64(32)
        out *= np.uint64(_MIX)
        out ^= out >> np.uint64(29)
    return out


def least(h, size: int):
    """The least of every ``size`` consecutive values."""
    import numpy as np

    width = 1
    while width * 2 <= size:
        h = np.minimum(h[: len(h) - width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (size - width)], h[size - width :]) if width < size else h


def anchors(h, window: int, anchor: int):
    """(anchor sequences' hashes, the anchor of each window)."""
    grams = rolled(h, anchor, _M1)
    return grams, least(grams, window - anchor + 1)


def _signed(a):
    import numpy as np

    return a.view(np.int64)


def window_digests(words: list[bytes], starts, window: int):
    """128-bit digests of the words of the windows at ``starts``, as two arrays of signed numbers."""
    import numpy as np
    from xxhash import xxh3_128_digest

    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.where(starts > 0, ends[starts - 1], 0).tolist()
    last = (ends[starts + window - 1] - 1).tolist()
    both = np.frombuffer(b"".join([xxh3_128_digest(joined[a:b]) for a, b in zip(first, last)]), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Index:
    """The log of runs in ``folder``: kind -> runs, oldest first. Tables are parquet, bucketed by key."""

    KEYS = {"digests": ["digest"], "anchors": ["anchor"], "windows": ["h1", "h2"]}

    def __init__(self, spark: SparkSession, folder: str, *, window: int = WINDOW, anchor: int = ANCHOR, fan_out: int = FAN_OUT) -> None:
        self.spark, self.folder, self.window, self.anchor, self.fan_out = spark, folder.rstrip("/"), window, anchor, fan_out
        self.runs: dict[str, list[dict]] = {k: [] for k in self.KEYS}
        self.texts: list[dict] = []
        self.merges = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        """The index that an earlier session left in ``folder``."""
        from .common import mapped

        data = mapped(f"{folder.rstrip('/')}/manifest.json")
        if data is None:
            raise FileNotFoundError(f"no index in {folder}")
        held = json.loads(bytes(data))
        index = cls(spark, folder, window=held["window"], anchor=held["anchor"], fan_out=held["fan_out"])
        index.runs, index.texts, index.merges = held["runs"], held["texts"], held["merges"]
        for run in [r for rs in index.runs.values() for r in rs] + index.texts:
            if not spark.catalog.tableExists(run["name"]):
                key = run["key"]
                spark.sql(f"CREATE TABLE {run['name']} ({run['columns']}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {run['buckets']} BUCKETS LOCATION '{index.folder}/{run['name']}'")
        return index

    def save(self) -> None:
        held = {"window": self.window, "anchor": self.anchor, "fan_out": self.fan_out, "runs": self.runs, "texts": self.texts, "merges": self.merges}
        put(f"{self.folder}/manifest.json", json.dumps(held).encode())

    def _write(self, kind: str, rows: DataFrame, keys: list[str], tier: int = 0) -> dict:
        """Write a table; unless it is dealt out by ``keys`` already, as by an aggregate, its rows are now."""
        name = f"run_{kind}_{uuid.uuid4().hex}"
        with writing(self.spark, {_PARTITIONS: str(max(1, int(self.spark.conf.get(_PARTITIONS)) // SHARE))}):
            # as many buckets as an aggregate deals its rows out to now
            buckets = int(self.spark.conf.get(_PARTITIONS))
            dealt = rows.repartition(buckets, *keys) if kind == "texts" else rows
            dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return {"name": name, "key": ", ".join(keys), "buckets": buckets, "tier": tier, "columns": columns}

    def append(self, kind: str, rows: DataFrame) -> DataFrame:
        """Write a run, merge what is due, and return the run."""
        run = self._write(kind, rows, self.KEYS[kind])
        self.runs[kind].append(run)
        return self.spark.table(run["name"])

    def compact(self, kind: str) -> list[dict]:
        """Merge the newest runs while FAN_OUT of them are of one tier; the runs that they replace."""
        old = []
        while len(last := self.runs[kind][-self.fan_out :]) == self.fan_out and len({r["tier"] for r in last}) == 1:
            rows = None
            for run in last:
                part = self.spark.table(run["name"]).select(*self.KEYS[kind], *(["uid", "stored"] if kind == "anchors" else []))
                rows = part if rows is None else rows.union(part)
            if kind == "anchors":
                rows = rows.groupBy("anchor").agg(F.min("uid").alias("uid"), F.max("stored").alias("stored"))
            else:
                rows = rows.distinct()
            self.runs[kind][-self.fan_out :] = [self._write(kind, rows, self.KEYS[kind], last[0]["tier"] + 1)]
            self.merges += 1
            old += last
        return old

    def drop(self, runs: list[dict]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run['name']}")
            remove(self.spark, f"{self.folder}/{run['name']}")

    def close(self) -> None:
        """Delete all runs, but not the texts."""
        for runs in self.runs.values():
            self.drop(runs)
            runs.clear()

    def merged(self, kind: str, rows: DataFrame) -> DataFrame:
        """``rows`` (one per key) merge-joined with every run: ``old`` says whether a run has the key; for anchors also ``old_uid`` and ``old_stored``."""
        keys, out, found = self.KEYS[kind], rows, []
        for i, run in enumerate(self.runs[kind]):
            values = ["uid", "stored"] if kind == "anchors" else []
            right = self.spark.table(run["name"]).select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias(f"_old{i}"), *[F.col(c).alias(f"_{c}{i}") for c in values])
            on = out[keys[0]] == right[f"_{keys[0]}"]
            for k in keys[1:]:
                on = on & (out[k] == right[f"_{k}"])
            out = out.join(right.hint("merge"), on, "left").drop(*[f"_{k}" for k in keys])
            found.append(i)

        def any_of(c: str, kind_: str, how):
            got = [F.col(f"_{c}{i}") for i in found]
            return F.lit(None).cast(kind_) if not got else got[0] if len(got) == 1 else how(*got)

        out = out.withColumn("old", F.coalesce(any_of("old", "boolean", F.coalesce), F.lit(False)))
        if kind == "anchors":
            out = out.withColumn("old_uid", any_of("uid", "long", F.least)).withColumn("old_stored", F.coalesce(any_of("stored", "boolean", F.greatest), F.lit(False)))
        return out.drop(*[f"_{c}{i}" for i in found for c in ("old", "uid", "stored")])

    def _store(self, docs: DataFrame, id_col: str, text_col: str, keep: bool) -> DataFrame:
        """The texts of a batch (uid, id, n, digest, z, and with ``keep`` row: the other columns), bucketed by row number."""
        arrow_batches(self.spark, BATCH_BYTES)
        columns = [F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")]
        if keep:
            columns.append(F.struct(*[F.col(quoted(c)) for c in docs.columns if c != text_col]).alias("row"))
        slim = docs.select(*columns)

        def scanned(batches: Iterator) -> Iterator:
            import hashlib

            import pyarrow as pa
            import zstandard

            tool = zstandard.ZstdCompressor(level=1)
            for b in batches:
                out = []
                for text in b.column(1):
                    data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    words = data.split()
                    out.append((len(words), hashlib.sha256(b" ".join(words)).digest(), tool.compress(data) if text.is_valid else None))
                n, digest, z = zip(*out) if out else ((),) * 3
                yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(z, pa.binary()), *b.columns[2:]], names=["id", "n", "digest", "z", "row"][: 4 + keep])

        from pyspark.sql.types import BinaryType, LongType, StructType

        schema = StructType([slim.schema["id"]]).add("n", LongType()).add("digest", BinaryType()).add("z", BinaryType())
        if keep:
            schema = schema.add(slim.schema["row"])
        number = len(self.texts)
        if number >> 63 - BATCH_BITS:
            raise ValueError("too many batches")
        uid = F.monotonically_increasing_id() + F.lit(number << BATCH_BITS)
        run = self._write("texts", slim.mapInArrow(lean(scanned), schema).withColumn("uid", uid), ["uid"])
        self.texts.append(run)
        return self.spark.table(run["name"])

    def ingest(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> tuple[DataFrame, DataFrame]:
        """(texts, marks) of a batch: its stored texts, and per uid whether the text is removed whole, and its windows that started earlier."""
        window, anchor = self.window, self.anchor
        temporary = []

        def kept(df: DataFrame, name: str) -> DataFrame:
            temporary.append(fresh(self.spark, name))
            return materialise(df, name, path=temporary[-1])

        store = self._store(docs, id_col, text_col, keep)
        # an id's place in the order: null comes last
        place = lambda *more: F.struct(F.col("id").isNull().alias("last"), "id", *more)
        long = store.filter(F.col("n") >= window).select("uid", "id", "digest")
        texts = kept(self.merged("digests", long.groupBy("digest").agg(F.min(place()).alias("own"), F.count("*").alias("rows"))), "texts")
        copies = attach(long, texts.filter("rows > 1 OR old"), "digest", "rows", ["own", "old"], F.col("uid")).filter(F.col("old") | (place() > F.col("own")))
        # copies of an earlier text go as a whole; only first holders are looked at further
        whole = kept(copies.select("uid"), "whole")

        def anchored(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa
            import zstandard

            tool = zstandard.ZstdDecompressor()
            for b in batches:
                found, again, uids = [], [], []
                for uid, z in zip(b.column(0).to_pylist(), b.column(1)):
                    grams, of = anchors(word_hashes(tool.decompress(z.as_py()).split()), window, anchor)
                    own = np.unique(of)
                    at = np.minimum(np.searchsorted(own, grams), len(own) - 1)
                    again.append(np.bincount(at[own[at] == grams], minlength=len(own)) > 1)
                    found.append(_signed(own))
                    uids.append(np.full(len(own), uid))
                if found:
                    yield pa.record_batch([pa.array(np.concatenate(found)), pa.array(np.concatenate(uids)), pa.array(np.concatenate(again))], names=["anchor", "uid", "again"])

        first = store.filter(F.col("n") >= window).select("uid", "z").join(whole.hint("shuffle_hash"), "uid", "left_anti")
        own = kept(first.mapInArrow(lean(anchored), "anchor long, uid long, again boolean"), "anchors")
        grouped = own.groupBy("anchor").agg(F.count("*").alias("rows"), F.min("uid").alias("own"), F.max("again").alias("again"))
        known = self.merged("anchors", grouped)
        # the run: all anchors of the batch; those met before or twice have their windows stored from now on
        run = self.append("anchors", known.select("anchor", F.coalesce("old_uid", "own").alias("uid"), (F.col("old") | F.col("again") | (F.col("rows") > 1)).alias("stored"), "rows", (F.col("old") & ~F.col("old_stored")).alias("late")))
        hits = attach(own.select("uid", "anchor"), run.filter("stored").select("anchor", "rows", F.lit(True).alias("hit")), "anchor", "rows", ["hit"], F.col("uid")).filter("hit")
        hits = hits.groupBy("uid").agg(F.collect_list("anchor").alias("anchors"))  # a text's own anchors

        def windows(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa
            import zstandard

            tool = zstandard.ZstdDecompressor()
            for b in batches:
                found, owners = [], []
                for row, (z, wanted) in enumerate(zip(b.column(2), b.column(3))):
                    words = tool.decompress(z.as_py()).split()
                    _, of = anchors(word_hashes(words), window, anchor)
                    start = np.flatnonzero(np.isin(_signed(of), np.asarray(wanted.values)))
                    if len(start):
                        found.append((*window_digests(words, start, window), start))
                        owners.append(np.full(len(start), row))
                if found:
                    h1, h2, start = (np.concatenate(x) for x in zip(*found))
                    owner = pa.array(np.concatenate(owners))
                    yield pa.record_batch([pa.array(h1), pa.array(h2), b.column(0).take(owner), b.column(1).take(owner), pa.array(start.astype(np.int32))], names=["h1", "h2", "uid", "id", "start"])

        schema = store.select(F.lit(1).cast("long").alias("h1"), F.lit(1).cast("long").alias("h2"), "uid", "id", F.lit(1).alias("start")).schema

        def hashed(texts_: DataFrame, asked: DataFrame) -> DataFrame:
            return texts_.join(asked.hint("shuffle_hash"), "uid").select("uid", "id", "z", "anchors").mapInArrow(lean(windows), schema)

        found = hashed(store, hits).withColumn("new", F.lit(True))
        late = kept(run.filter("late").groupBy("uid").agg(F.collect_list("anchor").alias("anchors")), "late") if len(self.texts) > 1 else None
        for number, held in enumerate(self.texts[:-1]):
            # anchors met once before: their windows aren't in the runs yet
            asked = late.filter(F.shiftright("uid", BATCH_BITS) == number)
            found = found.union(hashed(self.spark.table(held["name"]), asked).withColumn("new", F.lit(False)))
        found = kept(found, "windows")
        at = place("start")
        groups = found.groupBy("h1", "h2").agg(F.min(F.when(F.col("new"), at)).alias("own"), F.count(F.when(F.col("new"), 1)).alias("rows"), F.min("new").alias("all_new"))
        groups = self.merged("windows", groups)
        run = self.append("windows", groups.select("h1", "h2", "own", "rows", (F.col("old") | ~F.col("all_new")).alias("old")))
        key = F.struct("h1", "h2").alias("key")
        repeated = run.filter("rows > 1 OR old AND rows > 0").select(key, "rows", "own", "old")
        marked = attach(found.filter("new").select(key, "uid", "id", "start"), repeated, "key", "rows", ["own", "old"], F.struct("uid", "start")).filter(F.col("old") | (at > F.col("own")))
        starts = marked.groupBy("uid").agg(F.collect_set("start").alias("starts"))
        marks = whole.select("uid", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts")).union(starts.select("uid", F.lit(False), "starts"))
        marks = materialise(marks, "marks")

        self.append("digests", texts.filter("NOT old").select("digest"))
        replaced = [r for kind in self.runs for r in self.compact(kind)]
        self.save()
        self.drop(replaced)
        for path in temporary:
            remove(self.spark, path)
        return store, marks


def strip(data: bytes, starts: list[int], window: int, texts: bool) -> tuple[int, str, str | None]:
    """(words removed, SHA-256 of the kept words, the kept text if asked for) of a text without the words of the windows at ``starts``."""
    import hashlib
    import re

    import numpy as np

    words = data.split()
    edge = np.zeros(len(words) + window + 1, np.int32)
    s = np.asarray(starts)
    np.add.at(edge, s, 1)
    np.add.at(edge, s + window, -1)
    gone = np.cumsum(edge)[: len(words)] > 0
    left = [w for w, g in zip(words, gone.tolist()) if not g]
    kept = None
    if texts:
        parts, pieces = re.split(rb"([ \t-\r]+)", data), []
        at = 0
        for i, p in enumerate(parts):
            if i % 2 == 0 and p:
                if not gone[at]:
                    pieces.append(p + (parts[i + 1] if i + 1 < len(parts) else b""))
                at += 1
        kept = b"".join(pieces).decode("utf-8", "surrogatepass")
    return int(gone.sum()), hashlib.sha256(b" ".join(left)).hexdigest(), kept


def stripped(store: DataFrame, marks: DataFrame, window: int, texts: bool) -> DataFrame:
    """(id, text if ``texts``, row if it is stored, n_words, n_removed, kept_sha256) of stored texts."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    more = [c for c in ("row",) if c in store.columns]
    joined = store.join(marks.hint("shuffle_hash"), "uid", "left")
    # only texts that are asked for or lose a part of their words are unpacked
    z = F.col("z") if texts else F.when(F.col("starts").isNotNull(), F.col("z"))
    joined = joined.select("id", "n", "digest", z.alias("z"), F.coalesce("whole", F.lit(False)).alias("whole"), "starts", *more)
    nothing = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of no bytes

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        tool = zstandard.ZstdDecompressor()

        def one(n: int, digest: bytes, z: bytes | None, whole: bool, starts: list[int] | None) -> tuple:
            if whole:
                return n, n, nothing, ""
            if not starts:
                return n, 0, digest.hex(), tool.decompress(z).decode("utf-8", "surrogatepass") if texts and z is not None else None
            return n, *strip(tool.decompress(z), starts, window, texts)

        for b in batches:
            found = [one(*x) for x in zip(*(b.column(c).to_pylist() for c in range(1, 6)))]
            n, gone, digest, kept = zip(*found) if found else ((),) * 4
            yield pa.record_batch([b.column(0), *([pa.array(kept, pa.string())] if texts else []), *b.columns[6:], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=[f.name for f in schema])

    schema = StructType([store.schema["id"], *([StructField("text", StringType())] if texts else []), *[store.schema[c] for c in more], *[StructField(c, LongType()) for c in RESULTS[:2]], StructField(RESULTS[2], StringType())])
    return joined.mapInArrow(lean(run), schema)


def deduplicate(docs: DataFrame, *, batches: int = BATCHES, window: int = WINDOW, anchor: int = ANCHOR, fan_out: int = FAN_OUT, texts: bool = False, into: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per row of ``docs``, or with ``texts`` the columns of ``docs``, the text replaced by what is kept, and these three.

    The rows are ingested in ``batches`` of about equal size by id into a new index (in one, if ids aren't numbers), which is deleted afterwards.
    """
    spark = docs.sparkSession
    id = F.col(quoted(id_col))
    cuts: list = []
    if batches > 1 and docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        cuts = sorted(set(docs.select(F.percentile_approx(id, [k / batches for k in range(1, batches)], 1000)).first()[0] or []))
    index = Index(spark, fresh(spark, "fingerprints"), window=window, anchor=anchor, fan_out=fan_out)
    out, low, made = None, None, []
    for high in [*cuts, None]:
        here = docs if low is None else docs.filter((id > low) | id.isNull())
        here = here if high is None else here.filter(id <= high)
        store, marks = index.ingest(here, id_col=id_col, text_col=text_col, keep=texts)
        part = stripped(store, marks, window, texts)
        out = part if out is None else out.union(part)
        made.append(marks)
        low = high
    index.close()
    results = [F.struct(*RESULTS).alias(into)] if into else [F.col(c) for c in RESULTS]
    if texts:
        new = {into} if into else set(RESULTS)
        columns = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in new]
        leave(spark, index.folder)
        return out.select(*columns, *results)
    out = materialise(out.select(F.col("id").alias(id_col), *results), "passages")
    remove(spark, index.folder)
    return out
