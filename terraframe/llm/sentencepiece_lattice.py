"""SentencePiece encoding and decoding as a relational lattice.

A text falls into words that no piece crosses. Each distinct word is exploded into its substrings of bounded length, these are
equi-joined to the piece table, and the matches of a word are the edges of its lattice. A fold turns the lattice into the word's ids:

* for a unigram model a Viterbi fold over the positions, which keeps the best path to each;
* for a BPE model a fold over merges. The best path by the sum of scores isn't what a BPE model means: it merges,
  again and again, the pair of neighbours whose joint piece has the highest score. The same edges say which pairs are pieces.

``lattice(..., style="sql")`` groups the edges by an aggregate and folds them by the higher-order function ``aggregate``; the default style
"arrow" takes the edges as they stream (those of a word stay together, as nothing deals them out after the explode; this is checked) and folds
them in Python. Both give the same ids; see the README for what they cost.

Characters that are no piece become the pieces of their bytes. The ids of all distinct words form a sorted table of word hashes in the
shared folder, cut into parts of about PART_WORDS words, as many as the vocabulary needs. Tasks look words up there: by mapping a part into
memory where the folder is mounted, else through at most HELD_PARTS parts at a time. So no task holds the vocabulary, texts are never
shuffled, and there is one path for any number of words.

Nulls: a null text has no ids and decodes to null, an empty text has none and decodes to the empty text. Rows with equal texts are
encoded alike; an empty table gives an empty one. Words may be of any length: they are exploded in windows of WINDOW characters, and long ones
are merged from arrays and a heap. Only models without a normalisation table are accepted. Extra columns are kept, except those
named like the columns that are added.
"""

from __future__ import annotations

import re
import struct
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from .common import arrow_batches, fresh, lean, leave, materialise, remove

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words of a part of the dictionary (about 26 bytes each), and parts held at a time where the folder isn't mounted.
PART_WORDS = 1 << 16
HELD_PARTS = 16
#: Characters of a word that are exploded together.
WINDOW = 64
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


@dataclass(frozen=True)
class Model:
    """A piece table: (piece, id, score) of the pieces that match text, and what else encoding needs."""

    pieces: tuple[tuple[str, int, float], ...]
    names: tuple[str, ...]
    kinds: tuple[int, ...]
    bpe: bool
    prefix: bool
    byte_ids: tuple[int, ...]
    unknown: int

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            raise ValueError("not a SentencePiece model")
        yield tag >> 3, value


def parse_model(data: bytes) -> Model:
    rows, trainer, rules = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            rows.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, _NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            rules = dict(_fields(value))
    if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
        raise ValueError("only models that leave text as it is are supported")
    kind = trainer.get(3, 1)
    if kind not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    bytes_ = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(rows) if k == _BYTE}
    return Model(
        tuple((p, i, s) for i, (p, s, k) in enumerate(rows) if k in (_NORMAL, _USER)),
        tuple(p for p, _, _ in rows),
        tuple(k for _, _, k in rows),
        kind == 2,
        bool(rules.get(3, 1)),
        tuple(bytes_[b] for b in range(256)) if len(bytes_) == 256 else (),
        next((i for i, (_, _, k) in enumerate(rows) if k == _UNKNOWN), 0),
    )


def load_model(spark: SparkSession, path: str = MODEL) -> Model:
    with open(path, "rb") as f:
        return parse_model(f.read())


class Splitter:
    """Cuts a text into words that no piece crosses: before a space mark that follows something else, and around line ends."""

    def __init__(self, model: Model) -> None:
        inner = any(SPACE in p.lstrip(SPACE) for p, _, _ in model.pieces)
        lines = any("\n" in p and len(p) > 1 for p, _, _ in model.pieces)
        self.prefix, self.fast = model.prefix, not inner and not lines
        self.rx = re.compile(("" if lines else "\n|") + ("[^\n]+" if inner and not lines else "(?s:.+)" if inner else f"{SPACE}*[^{SPACE}{'' if lines else chr(10)}]+|{SPACE}+"))

    def __call__(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.fast or "  " in text or SPACE in text or text[0] == " ":
            return self.rx.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))
        marked = ((SPACE if self.prefix else "") + text).replace(" ", " " + SPACE)
        if "\n" not in marked:
            return marked.split(" ")
        return [w for w in marked.replace("\n", " \n ").split(" ") if w]

    def lists(self, texts: list[str | None]):
        """The words of each text as an Arrow list array, with empty strings between some of them; null for a null text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        marked: list[str | None] = []
        odd: dict[int, list[str]] = {}
        for i, t in enumerate(texts):
            if t and (not self.fast or "  " in t or SPACE in t or t[0] == " "):
                odd[i] = self(t)
                t = None
            elif t:
                t = ((SPACE if self.prefix else "") + t).replace(" ", " " + SPACE).replace("\n", " \n ")
            marked.append(t)
        out = pc.split_pattern(pa.array(marked, pa.string()), " ")
        if odd:
            place = {i: len(texts) + k for k, i in enumerate(odd)}
            both = pa.concat_arrays([out, pa.array(list(odd.values()), out.type)])
            out = both.take(pa.array([place.get(i, i) for i in range(len(texts))], pa.int64()))
        return out


def _stride(longest: int) -> int:
    """Edges are keyed by start and length; two neighbours together may be twice as long as a piece."""
    return 2 * longest + 1


def _merges(longest: int) -> Column:
    """Fold of the edges of a word into (start, length, id) by the merges of a BPE model."""
    joint = f"transform(sequence(1, size(a.sym) - 1), i -> transform(array(struct(a.sym[i - 1] AS p, a.sym[i] AS q)), x -> struct(element_at(edges, x.p.s * {_stride(longest)} + x.p.l + x.q.l) AS e, -i AS at))[0])"
    step = f"""
      CASE WHEN a.done OR size(a.sym) < 2 THEN struct(true AS done, a.sym AS sym)
      ELSE transform(array(array_max(transform({joint}, x -> struct(x.e.score AS score, x.at AS at, x.e.id AS id)))), b ->
        CASE WHEN b.id IS NULL THEN struct(true AS done, a.sym AS sym)
        ELSE struct(false AS done, concat(slice(a.sym, 1, -b.at - 1),
          array(struct(a.sym[-b.at - 1].s AS s, a.sym[-b.at - 1].l + a.sym[-b.at].l AS l, b.id AS id)),
          slice(a.sym, -b.at + 2, size(a.sym))) AS sym) END)[0] END"""
    start = f"transform(sequence(0, n - 1), i -> struct(i AS s, 1 AS l, element_at(edges, i * {_stride(longest)} + 1).id AS id))"
    return F.expr(f"aggregate(sequence(1, n), struct(false AS done, {start} AS sym), (a, k) -> {step}, a -> a.sym)")


def _viterbi(longest: int, worst: float) -> Column:
    """Fold of the edges of a word over its positions into the path with the best sum of scores; of equal sums the shortest last piece."""
    best = f"""
      array_max(transform(sequence(1, least({longest}, k)), l ->
        transform(array(element_at(edges, (k - l) * {_stride(longest)} + l)), e ->
          CASE WHEN e.id IS NOT NULL THEN struct(a[k - l].score + e.score AS score, -l AS l, e.id AS id)
               WHEN l = 1 THEN struct(a[k - 1].score + {worst!r}D AS score, -1 AS l, CAST(NULL AS INT) AS id) END)[0]))"""
    forward = f"aggregate(sequence(1, n), array(struct(0D AS score, 0 AS l, CAST(NULL AS INT) AS id)), (a, k) -> concat(a, array({best})))"
    back = """
      aggregate(sequence(1, n), struct(n AS at, slice(array(struct(0 AS s, 0 AS l, CAST(0 AS INT) AS id)), 1, 0) AS sym), (b, k) ->
        CASE WHEN b.at = 0 THEN b ELSE struct(b.at + f[b.at].l AS at, concat(array(struct(b.at + f[b.at].l AS s, -f[b.at].l AS l, f[b.at].id AS id)), b.sym) AS sym) END, b -> b.sym)"""
    return F.expr(f"transform(array({forward}), f -> {back})[0]")


def _edges(words: DataFrame, model: Model) -> DataFrame:
    """(wid, n, word, i, l, id, score): substring i, l of a word that is a piece, or a single character; the word is in its first row."""
    spark = words.sparkSession
    # bounded by the model: one row per piece
    table = F.broadcast(spark.createDataFrame([(p, i, float(s)) for p, i, s in model.pieces], "piece string, id int, score double"))
    numbered = words.select("word", F.char_length("word").alias("n"), F.monotonically_increasing_id().alias("wid"))
    # a long word in overlapping windows: else each of its substrings would be sought from its first character on
    cuts = numbered.select("wid", "word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(WINDOW))).alias("s"))
    windows = cuts.select("wid", "word", "n", "s", F.expr(f"substring(word, s + 1, {WINDOW + model.longest - 1})").alias("w"))
    starts = windows.select("wid", "word", "n", "s", "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.col("n") - F.col("s")))).alias("k"))
    spans = starts.select("wid", "word", "n", "s", "w", "k", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("n") - F.col("s") - F.col("k") + 1))).alias("l"))
    pieces = spans.select("wid", "word", "n", (F.col("s") + F.col("k")).alias("i"), "l", F.expr("substring(w, k, l)").alias("piece"))
    matched = pieces.join(table, "piece", "left").filter("id IS NOT NULL OR l = 1")
    return matched.select("wid", "n", F.when((F.col("i") == 1) & (F.col("l") == 1), F.col("word")).alias("first"), "word", "i", "l", "id", "score")


def lattice(words: DataFrame, model: Model, *, style: str = "arrow", packed: bool = False) -> DataFrame:
    """(word, ids array<int>) of distinct words that aren't empty; ``packed`` (style arrow) gives little-endian 32-bit numbers as a binary instead."""
    edges = _edges(words, model)
    if style == "sql":
        longest = model.longest
        at = ((F.col("i") - 1) * _stride(longest) + F.col("l")).alias("at")
        grouped = edges.groupBy("word").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct(at, F.struct("id", "score").alias("e")))).alias("edges"))
        worst = min((s for _, _, s in model.pieces), default=0.0) - 10.0
        folded = grouped.select("word", "n", (_merges(longest) if model.bpe else _viterbi(longest, worst)).alias("sym"))
        if model.byte_ids:
            fallback = "transform(sequence(1, octet_length(substring(word, x.s + 1, x.l))), b -> bytes[CAST(conv(substring(hex(substring(word, x.s + 1, x.l)), 2 * b - 1, 2), 16, 10) AS INT)])"
            folded = folded.withColumn("bytes", F.array(*[F.lit(i) for i in model.byte_ids]))
        else:
            fallback = f"array({model.unknown})"
        return folded.select("word", F.expr(f"CASE WHEN forall(sym, x -> x.id IS NOT NULL) THEN transform(sym, x -> x.id) ELSE flatten(transform(sym, x -> CASE WHEN x.id IS NULL THEN {fallback} ELSE array(x.id) END)) END").alias("ids"))

    levels = {v: k for k, v in enumerate(sorted({s for _, _, s in model.pieces}, reverse=True))}
    ranks = F.broadcast(words.sparkSession.createDataFrame([(i, levels[s]) for _, i, s in model.pieces], "id int, rank int"))
    stride = _stride(model.longest)
    at = (F.col("i").cast("long") - 1) * stride + F.col("l")
    # an edge is two numbers: where it lies, and its rank by score with its id; -1 for a character that is no piece
    value = F.coalesce(F.col("rank").cast("long") * (1 << 24) + F.col("id"), F.lit(-1).cast("long"))
    stream = edges.join(ranks, "id", "left").select("wid", "n", "first", at.alias("at"), value.alias("value"))
    scores = sorted(levels, reverse=True)
    name = "packed" if packed else "ids"
    # only what the fold needs goes to the tasks, not the piece table
    spelling, bpe = Spelling(model.byte_ids, model.unknown), model.bpe

    def folded_(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: list | None = None

        def finish(word: str, n: int, at: list, value: list):
            if not bpe:
                edge = dict(zip(np.concatenate(at).tolist(), np.concatenate(value).tolist()))
                ids = best_path(word, n, checked(edge, n, stride), stride, scores, spelling)
            elif n <= SCANNED:
                edge = dict(zip(at[0].tolist(), value[0].tolist())) if len(at) == 1 else dict(zip(np.concatenate(at).tolist(), np.concatenate(value).tolist()))
                ids = merge(word, n, checked(edge, n, stride), stride, spelling)
            else:
                ids = merge_long(word, n, np.concatenate(at), np.concatenate(value), stride, spelling)
            return word, struct.pack(f"<{len(ids)}i", *ids) if packed else ids

        def batch(out: list):
            return pa.record_batch([pa.array([w for w, _ in out], pa.string()), pa.array([i for _, i in out], pa.binary() if packed else pa.list_(pa.int32()))], names=["word", name])

        for b in batches:
            wid = np.asarray(b.column("wid"))
            if not len(wid):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(wid)) + 1, [len(wid)]])
            heads = cuts[:-1]
            wids, ns = wid[heads].tolist(), np.asarray(b.column("n"))[heads].tolist()
            firsts = b.column("first").take(pa.array(heads)).to_pylist()
            places, values, cuts = np.asarray(b.column("at")), np.asarray(b.column("value")), cuts.tolist()
            out = []
            for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
                if held is not None and held[0] == wids[k]:
                    held[3].append(places[low:high].copy())
                    held[4].append(values[low:high].copy())
                    continue
                if held is not None:
                    out.append(finish(*held[1:]))
                if firsts[k] is None:
                    raise RuntimeError("the edges of a word came apart")
                held = [wids[k], firsts[k], ns[k], [places[low:high]], [values[low:high]]]
            held[3], held[4] = [x.copy() for x in held[3]], [x.copy() for x in held[4]]  # nothing of the batch stays
            if out:
                yield batch(out)
        if held is not None:
            yield batch([finish(*held[1:])])

    return stream.mapInArrow(lean(folded_), f"word string, {name} {'binary' if packed else 'array<int>'}")


class Spelling(NamedTuple):
    """The ids of bytes, or the one of anything unknown."""

    byte_ids: tuple[int, ...]
    unknown: int


def checked(edge: dict, n: int, stride: int) -> dict:
    """The edges of a word, if those of all its single characters are there."""
    if not all(k in edge for k in range(1, n * stride, stride)):
        raise RuntimeError("the edges of a word came apart")
    return edge


def spelled(text: str, spelling: Spelling) -> list[int]:
    """The ids of a character that is no piece."""
    return [spelling.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")] if spelling.byte_ids else [spelling.unknown]


_ID = (1 << 24) - 1
#: Words longer than this are merged from a heap instead of a scan of all pairs; the ids are the same.
SCANNED = 256
_NONE = 1 << 60


def _ids(word: str, bounds: list[int], edge, stride: int, spelling: Spelling) -> list[int]:
    out = []
    for a, b in zip(bounds, bounds[1:]):
        v = edge(a * stride + b - a)
        if v >= 0:
            out.append(v & _ID)
        else:
            out += spelled(word[a:b], spelling)
    return out


def merge(word: str, n: int, edge: dict, stride: int, spelling: Spelling) -> list[int]:
    """Fold of a BPE model: join the neighbours whose joint piece scores highest, of equal ones the first, until none is a piece.

    ``edge``: start * stride + length -> rank by score, then the id.
    """
    get = edge.get
    bounds = list(range(n + 1))
    pairs = [get(k * stride + 2, _NONE) >> 24 for k in range(n - 1)]
    none = _NONE >> 24
    while pairs:
        low = min(pairs)
        if low == none:
            break
        k = pairs.index(low)
        del bounds[k + 1], pairs[k]
        if k:
            pairs[k - 1] = get(bounds[k - 1] * stride + bounds[k + 1] - bounds[k - 1], _NONE) >> 24
        if k < len(pairs):
            pairs[k] = get(bounds[k] * stride + bounds[k + 2] - bounds[k], _NONE) >> 24
    return _ids(word, bounds, edge.__getitem__, stride, spelling)


def merge_long(word: str, n: int, at, value, stride: int, spelling: Spelling) -> list[int]:
    """``merge`` for a long word: edges in sorted arrays, merges from a heap of (rank, start) in one number each."""
    import heapq
    from array import array
    from bisect import bisect_left

    import numpy as np

    order = np.argsort(at)
    at, value = array("q", at[order].tobytes()), array("q", value[order].tobytes())

    def get(k: int) -> int:
        i = bisect_left(at, k)
        return value[i] if i < len(at) and at[i] == k else _NONE

    if any(get(k) == _NONE for k in range(1, n * stride, stride)):
        raise RuntimeError("the edges of a word came apart")
    longest, none = (stride - 1) // 2, _NONE >> 24
    after, before = array("q", range(1, n + 2)), array("q", range(-1, n))

    def rank(a: int) -> int:
        """Of the symbol at ``a`` and its neighbour."""
        if (b := after[a]) >= n or (c := after[b]) - a > longest:
            return none
        return get(a * stride + c - a) >> 24

    heap = [r << 40 | a for a in range(n - 1) if (r := rank(a)) != none]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        r, a = (x := heapq.heappop(heap)) >> 40, x & (1 << 40) - 1
        if gone[a] or rank(a) != r:
            continue  # its neighbours have changed
        b = after[a]
        gone[b], after[a] = 1, after[b]
        if after[b] < n:
            before[after[b]] = a
        for k in (before[a], a):
            if k >= 0 and (r := rank(k)) != none:
                heapq.heappush(heap, r << 40 | k)
    bounds = [0]
    while bounds[-1] < n:
        bounds.append(after[bounds[-1]])
    return _ids(word, bounds, get, stride, spelling)


def best_path(word: str, n: int, edge: dict, stride: int, scores: list[float], spelling: Spelling) -> list[int]:
    """Viterbi fold of a unigram model: the best sum of scores to each position; of equal sums the shortest last piece."""
    worst, longest = min(scores, default=0.0) - 10.0, (stride - 1) // 2
    best: list[tuple[float, int]] = [(0.0, 0)]
    for k in range(1, n + 1):
        options = []
        for l in range(1, min(longest, k) + 1):
            v = edge.get((k - l) * stride + l)
            if v is not None:
                options.append((best[k - l][0] + (worst if v < 0 else scores[v >> 24]), -l))
        best.append(max(options))
    bounds = [n]
    while bounds[-1]:
        bounds.append(bounds[-1] + best[bounds[-1]][1])
    return _ids(word, bounds[::-1], edge.__getitem__, stride, spelling)


class Dictionary:
    """Words' ids by hash, in 2 ** bits parts that lie in the shared folder: sorted hashes, ends of the ids, ids."""

    def __init__(self, folder: str, bits: int) -> None:
        from .common import mapped

        self.folder, self.bits, self.parts, self.mapped = folder, bits, OrderedDict(), mapped

    def _part(self, k: int):
        import mmap

        import numpy as np
        import pyarrow as pa

        if k in self.parts:
            self.parts.move_to_end(k)
            return self.parts[k]
        data = self.mapped(f"{self.folder}/part-{k}")
        if data is None:
            raise RuntimeError("a part of the dictionary is missing")
        n = int(np.frombuffer(data, "<u8", 1)[0])
        buffer = pa.py_buffer(data)
        ids = pa.BinaryArray.from_buffers(pa.binary(), n, [None, buffer.slice(8 + 8 * n, 4 * (n + 1)), buffer.slice(8 + 8 * n + 4 * (n + 1))])
        self.parts[k] = np.frombuffer(data, "<u8", n, 8), ids
        if not isinstance(data, mmap.mmap) and len(self.parts) > HELD_PARTS:
            self.parts.popitem(last=False)
        return self.parts[k]

    def look_up(self, words):
        """The ids of each word of an Arrow array, packed; the empty string has none, any other must be in the dictionary."""
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        texts = words.to_pylist()
        h = np.fromiter(map(xxh3_64_intdigest, texts), np.uint64, len(texts))
        order = np.argsort(h)
        h = h[order]
        part = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        found, empty = [], xxh3_64_intdigest("")
        for low, high in runs(part):
            if "" in (texts[i] for i in order[low:high][h[low:high] == empty]):
                at = low + int(np.searchsorted(h[low:high], np.uint64(empty)))
                spans = [(low, at), (at + 1, high)]
            else:
                at, spans = -1, [(low, high)]
            for n, (a, b) in enumerate(spans):
                if n:
                    found.append(pa.array([b""], pa.binary()))
                if a < b:
                    keys, ids = self._part(int(part[a]))
                    where = np.searchsorted(keys, h[a:b])
                    if where[-1] >= len(keys) or (keys[where] != h[a:b]).any():
                        raise RuntimeError("a word isn't in the dictionary")
                    found.append(ids.take(pa.array(where)))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return pa.concat_arrays(found).take(pa.array(back)) if found else pa.array([], pa.binary())


def runs(sorted_values) -> list[tuple[int, int]]:
    """(from, to) of each run of equal values."""
    import numpy as np

    if not len(sorted_values):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(sorted_values)) + 1).tolist(), len(sorted_values)]
    return list(zip(cuts, cuts[1:]))


def _build(words: DataFrame, folder: str, bits: int) -> None:
    """Write the dictionary of (word, packed); one file per part, whole or not at all."""

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for b in batches:
            h = [xxh3_64_intdigest(w.as_py()) for w in b.column("word")]
            yield pa.record_batch([pa.array([x >> (64 - bits) for x in h], pa.int32()), pa.array([x - (1 << 64) if x >> 63 else x for x in h], pa.int64()), b.column("packed")], names=["part", "h", "packed"])

    def written(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .common import put

        part, h, packed = None, [], []
        done = 0

        def close() -> None:
            ids = pa.concat_arrays(packed)
            ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            data = memoryview(ids.buffers()[2])[ends[0] : ends[-1]]
            put(f"{folder}/part-{part}", b"".join([np.uint64(len(ids)).tobytes(), np.concatenate(h).astype("<u8").tobytes(), (ends - ends[0]).astype("<u4").tobytes(), data]))

        for b in batches:
            parts = np.asarray(b.column("part"))
            for low, high in runs(parts):
                if parts[low] != part:
                    if part is not None:
                        close()
                        done += 1
                    part, h, packed = int(parts[low]), [], []
                h.append(np.asarray(b.column("h"))[low:high].view(np.uint64).copy())
                packed.append(b.column("packed").slice(low, high - low))
        if part is not None:
            close()
            done += 1
        yield pa.record_batch([pa.array([done], pa.int32())], names=["parts"])

    dealt = words.select("word", "packed").mapInArrow(lean(hashed), "part int, h long, packed binary")
    # in the order of unsigned hashes
    dealt = dealt.repartition(min(1 << bits, 4096), "part").sortWithinPartitions("part", F.col("h").bitwiseXOR(F.lit(-(1 << 63))))
    dealt.mapInArrow(lean(written), "parts int").agg(F.sum("parts")).collect()


def _texts(model: Model) -> list[bytes]:
    """The bytes of each id."""
    return [bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(SPACE, " ").encode() for p, k in zip(model.names, model.kinds)]


def decode_ids(ids, model: Model) -> str:
    """The text of a sequence of ids."""
    texts = _texts(model)
    return _joined([texts[i] for i in ids], model.prefix)


def _joined(pieces: list[bytes], prefix: bool) -> str:
    out = b"".join(pieces).decode("utf-8", "replace")
    return out[1:] if prefix and out[:1] == " " else out


def encode(docs: DataFrame, model: Model, *, text_col: str = "text", tokens_col: str = "tokens", decode_to: str | None = None) -> DataFrame:
    """``docs`` with ``tokens_col``, the ids of the text as a binary of little-endian 32-bit numbers (null for a null text).

    ``decode_to`` adds the text that these ids decode to, in the same pass.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    split = Splitter(model)

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        seen = pa.array([], pa.string())
        for b in batches:
            seen = pc.unique(pa.concat_arrays([seen, pc.unique(split.lists(b.column(0).to_pylist()).flatten())]))
            if len(seen) > 100_000:
                yield pa.record_batch([seen], names=["word"])
                seen = seen.slice(0, 0)
        yield pa.record_batch([seen], names=["word"])

    at_encoded = fresh(spark, "encoded-words")
    words = docs.select(text_col).mapInArrow(lean(counted), "word string").filter("word <> ''").distinct()
    # dealt anew: the words of a partition are all there is to explode there
    encoded = materialise(lattice(words.repartition(F.col("word")), model, packed=True), "encoded-words", path=at_encoded)
    folder, bits = fresh(spark, "dictionary"), max(1, -(-encoded.count() // PART_WORDS) - 1).bit_length()
    _build(encoded, folder, bits)
    remove(spark, at_encoded)
    leave(spark, folder)

    columns = [c for c in docs.columns if c not in (tokens_col, decode_to)]
    schema = StructType([f for f in docs.schema.fields if f.name in columns]).add(tokens_col, BinaryType())
    if decode_to:
        schema = schema.add(decode_to, StringType())
    texts, prefix = _texts(model) if decode_to else [], model.prefix
    at = columns.index(text_col)

    def filled(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table, pieces = Dictionary(folder, bits), pa.array(texts, pa.binary())
        for b in batches:
            lists = split.lists(b.column(at).to_pylist())
            words = lists.values.dictionary_encode()
            ids = table.look_up(words.dictionary).take(words.indices)
            # where the ids of each text end, in bytes; those of all texts lie behind one another
            ends = np.frombuffer(ids.buffers()[1], np.int32)[np.asarray(lists.offsets)].tolist()
            data = memoryview(ids.buffers()[2] or b"")
            valid = lists.is_valid().to_pylist()
            tokens = pa.array([bytes(data[x:y]) if v else None for x, y, v in zip(ends, ends[1:], valid)], pa.binary())
            if not decode_to:
                yield pa.record_batch([*b.columns, tokens], names=[f.name for f in schema])
                continue
            spelt = pieces.take(pa.array(np.frombuffer(data, "<i4", ends[-1] // 4)))
            places = np.frombuffer(spelt.buffers()[1], np.int32)[np.array(ends) // 4].tolist()
            letters = memoryview(spelt.buffers()[2] or b"")
            decoded = pa.array([_joined([letters[x:y]], prefix) if v else None for x, y, v in zip(places, places[1:], valid)], pa.string())
            yield pa.record_batch([*b.columns, tokens, decoded], names=[f.name for f in schema])

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(lean(filled), schema)


def decode(docs: DataFrame, model: Model, *, tokens_col: str = "tokens", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``tokens_col``: ids are looked up in the piece table, at most one row per piece of the model."""
    arrow_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c != out_col]
    schema = StructType([f for f in docs.schema.fields if f.name != out_col]).add(out_col, StringType())
    texts, prefix, at = _texts(model), model.prefix, columns.index(tokens_col)

    def decoded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        pieces = np.empty(len(texts), object)
        pieces[:] = texts
        for b in batches:
            out = [_joined(pieces[np.frombuffer(x.as_py(), "<i4")].tolist(), prefix) if x.is_valid else None for x in b.column(at)]
            yield pa.record_batch([*b.columns, pa.array(out, pa.string())], names=[f.name for f in schema])

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(lean(decoded), schema)
