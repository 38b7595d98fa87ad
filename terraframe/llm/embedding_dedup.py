"""Near-duplicate embeddings: exact threshold pairs by a dual traversal of a cover tree.

Equal vectors form one class. The cover tree over the unit vectors has nested levels with halving radii: a node's children contain its own
centre and lie further apart than the level's radius. It is grown in rounds, so that its depth follows the data: every node with more
than LEAF classes gets a subtree of several levels, fitted by a task on a sample of that node alone (about SAMPLE classes of it, drawn by hash), and
all its classes, sampled or not, descend to the nearest child at each level. Covering radii are taken from all classes below a node, so
the bounds hold for all rows and the result is exact whatever the samples. Vectors of different lengths start from roots of their own.

The traversal descends both sides, round by round: a pair of nodes is pruned if the distance of their centres exceeds both covering
radii plus the distance that the cosine threshold allows, and it is taken whole if even the furthest vectors below the two are near enough.
Pairs of leaves that are left are compared in memory, in blocks of about BLOCK vectors that are read by offset from the shared folder; memory is
bounded by two blocks. No pairs are emitted: a comparison gives each class its number of links, and a spanning forest of the links for the components.

What a level would scatter into almost as many children as points (vectors without clusters in many dimensions, whose distances hardly differ) can't
be ruled out by covering radii; such a node isn't split but cut into blocks, which are all compared with each other: work grows with the square there.

Cosines near the threshold are taken in double precision from the vectors as given. Nulls: vectors that are null, empty, zero, or hold null or
non-finite components link with nothing; so do vectors of different lengths. A row with a null id links like any other and takes
the component's smallest id, or null if no row of the component has an id. Rows that repeat an id are vectors of their own. An empty
table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import arrow_batches, attach, connected_components, fresh, leave, materialise, quoted, remove

#: Classes that a node's subtree is fitted on, the subtree's most nodes, and sampled classes below which a level isn't split.
SAMPLE = 2048
MAX_NODES = 512
LEAF_SAMPLE = 16
#: Nodes with more classes are split; vectors of a block.
LEAF = 512
BLOCK = 1024
#: Classes of a node that one task takes as it descends.
CHUNK = 50_000
#: Pairs of blocks that share their first block and one task.
TOGETHER = 256
#: Blocks that a task keeps at hand.
HELD = 32
#: Single precision is off by less than this; what is nearer to the threshold is taken anew in double precision.
MARGIN = 1e-4
#: Room for rounding in the bounds.
EPSILON = 1e-9
_PATH = "array<struct<of:string,k:int,dist:double>>"


def cover_tree(points, radius: float, smallest: float) -> list[tuple[int, int, float]]:
    """[(parent node, index of the centre, level's radius)], the root first; the root's centre is the first point."""
    import numpy as np

    nodes, todo = [(-1, 0, radius)], [(0, np.arange(len(points)), radius)]
    while todo and len(nodes) < MAX_NODES:
        at, members, radius = todo.pop(0)
        radius /= 2
        if len(members) < LEAF_SAMPLE or radius < smallest:
            continue
        own = nodes[at][1]
        centres, nearest = [own], np.linalg.norm(points[members] - points[own], axis=1)
        label = np.zeros(len(members), int)
        most = min(len(members) // 4, MAX_NODES - len(nodes))
        while nearest.max() > radius and len(centres) <= most:
            far = int(nearest.argmax())
            d = np.linalg.norm(points[members] - points[members[far]], axis=1)
            label[d < nearest] = len(centres)
            nearest = np.minimum(nearest, d)
            centres.append(int(members[far]))
        if len(centres) > most:
            continue
        if len(centres) == 1:
            nodes[at] = (*nodes[at][:2], radius)
            todo.append((at, members, radius))
            continue
        for k, c in enumerate(centres):
            nodes.append((at, c, radius))
            todo.append((len(nodes) - 1, members[label == k], radius))
    return nodes


class Subtree:
    """Nodes of a subtree: parents, centres, levels' radii; and if known, of all classes below each: covering radius, classes, rows, smallest class."""

    def __init__(self, parents, centres, levels) -> None:
        self.parents, self.centres, self.levels = parents, centres, levels
        self.children: list[list[int]] = [[] for _ in parents]
        for k, p in enumerate(parents):
            if p >= 0:
                self.children[p].append(k)

    def pack(self) -> bytes:
        import pickle

        return pickle.dumps((self.parents, self.centres, self.levels))

    @classmethod
    def unpack(cls, data: bytes) -> Subtree:
        import pickle

        return cls(*pickle.loads(data))

    def descend(self, vectors):
        """(leaf of each unit vector, by the nearest child at each level; [(rows, node, distances)] of the nodes passed below the root)."""
        import numpy as np

        out, passed, todo = np.zeros(len(vectors), int), [], [(0, np.arange(len(vectors)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            kids = self.children[at]
            if not kids:
                out[rows] = at
                continue
            best = (vectors[rows] @ self.centres[kids].T).argmax(axis=1)
            for i, k in enumerate(kids):
                mine = rows[best == i]
                if len(mine):
                    passed.append((mine, k, np.linalg.norm(vectors[mine] - self.centres[k], axis=1)))
                    todo.append((k, mine))
        return out, passed


def traverse(a: Subtree, b: Subtree, same: bool, reach: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(pairs of leaves to look at further, pairs of nodes whose vectors all link) of two subtrees, or of one with itself.

    ``radius`` of the subtrees is -1 where no class is below a node.
    """
    import numpy as np

    rest, whole, todo = [], [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        if a.radius[i] < 0 or b.radius[j] < 0:
            continue
        one = same and i == j
        gap = 0.0 if one else float(np.linalg.norm(a.centres[i] - b.centres[j]))
        both = a.radius[i] + b.radius[j]
        if gap - both > reach + EPSILON:
            continue
        if gap + both <= reach - EPSILON:
            whole.append((i, j))
            continue
        left, right = a.children[i], b.children[j]
        if one:
            if left:
                todo += [(x, y) for n, x in enumerate(left) for y in left[n:]]
            else:
                rest.append((i, j))
        elif left and (not right or a.radius[i] >= b.radius[j]):
            todo += [(x, j) for x in left]
        elif right:
            todo += [(i, y) for y in right]
        else:
            rest.append((i, j))
    return rest, whole


def forest(mask, rows, columns) -> list[tuple[int, int]]:
    """Links that connect what ``mask`` [row, column] links, at most one per row and column."""
    import numpy as np

    r, c = mask.any(axis=1), mask.any(axis=0)
    if not r.any():
        return []
    mask, rows, columns = mask[np.ix_(r, c)], rows[r], columns[c]
    big = np.iinfo(np.int64).max
    low_r = rows.copy()
    low_c = columns.copy()
    while True:
        new_c = np.minimum(low_c, np.where(mask, low_r[:, None], big).min(axis=0))
        new_r = np.minimum(low_r, np.where(mask, new_c[None, :], big).min(axis=1))
        if (new_c == low_c).all() and (new_r == low_r).all():
            break
        low_r, low_c = new_r, new_c
    ends = {(int(a), int(b)) for a, b in zip(np.concatenate([rows, columns]), np.concatenate([low_r, low_c])) if a != b}
    return sorted(ends)


def _units(data, kind: str, dimension: int):
    import numpy as np

    x = np.frombuffer(data, kind).reshape(-1, dimension).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def grow(classes: DataFrame, kind: str, threshold: float, temporary: list[str]) -> tuple[DataFrame, DataFrame, str]:
    """(rows, trees, folder): each class (cid, n, dim, vector) at its leaf, with the nodes on its way, the subtrees (of, nodes, round), and where they lie.

    ``kind``: numpy's type of the components. A node is named by its subtree's root and its number there; roots are named by the length.
    """
    folder = fresh(classes.sparkSession, "subtrees")
    temporary.append(folder)

    def kept(df: DataFrame, name: str) -> DataFrame:
        temporary.append(fresh(df.sparkSession, name))
        return materialise(df, name, path=temporary[-1])

    smallest = (2 - 2 * threshold) ** 0.5 / 8
    active = classes.select("cid", "n", "dim", "vector", F.col("dim").cast("string").alias("node"), F.lit(2.0).alias("radius"), F.array().cast(_PATH).alias("path"))
    done, trees, round_ = None, None, 0
    while True:
        counts = kept(active.groupBy("node").agg(F.count("*").alias("m")), "node-counts")
        # a root is always split, so that each class has a centre; others only if they are large
        big = counts if round_ == 0 else counts.filter(F.col("m") > LEAF)
        if big.isEmpty():
            rest = active.filter(F.lit(round_ > 0))
            return (rest if done is None else done.union(rest)), trees, folder
        held = attach(active, big, "node", "m", ["m"], F.col("cid"))
        if round_:
            rest = held.filter("m IS NULL").drop("m")
            done = rest if done is None else done.union(rest)
        large = held.filter("m IS NOT NULL")
        share = F.pmod(F.xxhash64("cid"), F.lit(1 << 40)) / float(1 << 40)

        def fitted(t):
            import numpy as np
            import pyarrow as pa

            from .common import mapped, put

            node, dim, radius = (t.column(c)[0].as_py() for c in ("node", "dim", "radius"))
            order = np.argsort(t.column("cid").to_numpy())
            points = _units(b"".join(t.column("vector").to_pylist()), kind, dim)[order]
            above, dot, k = node.rpartition(".")
            if dot:  # the node keeps the centre that it has in the subtree above
                points = np.concatenate([Subtree.unpack(bytes(mapped(f"{folder}/{above}"))).centres[[int(k)]], points])
            nodes = cover_tree(points, radius, smallest)
            put(f"{folder}/{node}", Subtree([p for p, _, _ in nodes], points[[c for _, c, _ in nodes]], [r for _, _, r in nodes]).pack())
            return pa.table({"of": [node], "nodes": pa.array([len(nodes)], pa.int32())})

        # about SAMPLE classes of a node, and one at least
        sample = large.filter((share < SAMPLE / F.col("m")) | (F.col("m") <= SAMPLE)).select("node", "dim", "radius", "cid", "vector")
        here = kept(sample.groupBy("node").applyInArrow(fitted, "of string, nodes int"), "subtrees")
        part = here.withColumn("round", F.lit(round_))
        trees = part if trees is None else trees.union(part)

        def descended(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            from .common import mapped

            name, tree = None, None
            for b in batches:
                nodes = b.column("node").to_pylist()
                cuts = [0, *(i for i in range(1, len(nodes)) if nodes[i] != nodes[i - 1]), len(nodes)] if nodes else []
                for low, high in zip(cuts, cuts[1:]):
                    x = b.slice(low, high - low)
                    if nodes[low] != name:
                        name = nodes[low]
                        tree = Subtree.unpack(bytes(mapped(f"{folder}/{name}")))
                    unit = _units(b"".join(x.column("vector").to_pylist()), kind, x.column("dim")[0].as_py())
                    leaf, passed = tree.descend(unit)
                    paths = x.column("path").to_pylist()
                    if not paths[0]:
                        for p, dist in zip(paths, np.linalg.norm(unit - tree.centres[0], axis=1).tolist()):
                            p.append({"of": name, "k": 0, "dist": dist})
                    for rows, k, dist in passed:
                        for i, d in zip(rows.tolist(), dist.tolist()):
                            paths[i].append({"of": name, "k": k, "dist": d})
                    below = pa.array([f"{name}.{k}" if k else name for k in leaf.tolist()], pa.string())
                    levels = pa.array([tree.levels[k] for k in leaf.tolist()], pa.float64())
                    path = pa.array(paths, pa.list_(pa.struct([("of", pa.string()), ("k", pa.int32()), ("dist", pa.float64())])))
                    yield pa.record_batch([x.column("cid"), x.column("n"), x.column("dim"), x.column("vector"), below, levels, path], names=["cid", "n", "dim", "vector", "node", "radius", "path"])

        salt = F.pmod(F.xxhash64("cid"), F.ceil(F.col("m") / CHUNK))
        dealt = large.withColumn("salt", salt).repartition(F.col("node"), F.col("salt")).sortWithinPartitions("node").select("cid", "n", "dim", "vector", "node", "radius", "path")
        moved = kept(dealt.mapInArrow(descended, f"cid long, n long, dim int, vector binary, node string, radius double, path {_PATH}"), "descended")
        # what a subtree of one node doesn't split, no other would
        alone = here.filter("nodes = 1").select(F.col("of").alias("stuck"))
        whole = moved.join(F.broadcast(alone) if alone.count() <= 1000 else alone, F.col("node") == F.col("stuck"), "left")
        rest = whole.filter("stuck IS NOT NULL").drop("stuck")
        done = rest if done is None else done.union(rest)
        active = whole.filter("stuck IS NULL").drop("stuck")
        round_ += 1


def candidates(rows: DataFrame, trees: DataFrame, folder: str, threshold: float, temporary: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rest, whole): pairs of leaves (a, b) whose vectors are to be compared, and pairs of nodes (of_a, k_a, of_b, k_b) whose vectors all link."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        temporary.append(fresh(df.sparkSession, name))
        return materialise(df, name, path=temporary[-1])

    reach = (2 - 2 * threshold) ** 0.5
    stats = rows.select("cid", F.explode("path").alias("p")).groupBy("p.of", "p.k").agg(F.max("p.dist").alias("radius"))
    # a subtree has MAX_NODES nodes at most
    stats = stats.groupBy("of").agg(F.collect_list(F.struct("k", "radius")).alias("radii"))

    def noted(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa

        from .common import put

        for b in batches:
            for of, radii in zip(b.column("of").to_pylist(), b.column("radii").to_pylist()):
                put(f"{folder}/{of}.radii", pickle.dumps([(x["k"], x["radius"]) for x in radii]))
            yield pa.record_batch([b.column("of")], names=["of"])

    stats.mapInArrow(noted, "of string").count()
    schema = "kind int, a string, b string, of_a string, k_a int, of_b string, k_b int, point_a binary, point_b binary"

    def walked(batches: Iterator) -> Iterator:
        import pickle
        from functools import lru_cache

        import numpy as np
        import pyarrow as pa

        from .common import mapped

        @lru_cache(HELD)
        def known(name: str) -> Subtree:
            tree = Subtree.unpack(bytes(mapped(f"{folder}/{name}")))
            tree.radius = np.full(len(tree.parents), -1.0)
            if (radii := mapped(f"{folder}/{name}.radii")) is not None:
                for k, radius in pickle.loads(bytes(radii)):
                    tree.radius[k] = radius
            return tree

        def side(name: str, split: bool, point: bytes | None) -> Subtree:
            centre, radius = pickle.loads(point) if point is not None else (None, None)
            if split:
                tree = known(name)
                if point is not None:  # the subtree above knows the radius of the root
                    tree.radius[0] = radius
            else:
                tree = Subtree([-1], centre[None, :], [0.0])
                tree.radius = np.array([radius])
            return tree

        for batch in batches:
            for r in batch.to_pylist():
                same = r["a"] == r["b"]
                x = side(r["a"], r["split_a"], r["point_a"])
                y = x if same else side(r["b"], r["split_b"], r["point_b"])
                rest, whole = traverse(x, y, same, reach)
                # a root's place is that in the subtree above, if there is one
                place = lambda s, k: (r[s], k) if r[f"split_{s}"] and (k or r[f"of_{s}"] is None) else (r[f"of_{s}"], r[f"k_{s}"])
                name = lambda s, k: f"{r[s]}.{k}" if k else r[s]
                out = []
                for kind, found in ((0, rest), (1, whole)):
                    for i, j in found:
                        points = [pickle.dumps((t.centres[k], float(t.radius[k]))) if kind == 0 else None for t, k in ((x, i), (y, j))]
                        out.append((kind, name("a", i), name("b", j), *place("a", i), *place("b", j), *points))
                if out:
                    types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["kind", "a", "b", "of_a", "k_a", "of_b", "k_b", "point_a", "point_b"])

    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    roots = trees.filter("round = 0").select(F.col("of").alias("a"), F.col("of").alias("b"), *(null(kind, c) for kind, c in (("string", "of_a"), ("int", "k_a"), ("string", "of_b"), ("int", "k_b"), ("binary", "point_a"), ("binary", "point_b"))))
    pairs = roots.withColumns({"split_a": F.lit(True), "split_b": F.lit(True)})
    rest = whole = None
    for number in range(1 + trees.agg(F.max("round")).first()[0]):
        walk = kept(pairs.repartition(F.col("a"), F.col("b")).sortWithinPartitions("a", "b").mapInArrow(walked, schema), "node-pairs")
        part = walk.filter("kind = 1").select("of_a", "k_a", "of_b", "k_b")
        whole = part if whole is None else whole.union(part)
        # pairs of which a side is split further, and the others
        next_ = trees.filter(F.col("round") == number + 1).select("of")
        going = walk.filter("kind = 0").drop("kind")
        for s in "ab":
            going = going.join(next_.withColumnRenamed("of", f"next_{s}"), F.col(s) == F.col(f"next_{s}"), "left").withColumn(f"split_{s}", F.col(f"next_{s}").isNotNull()).drop(f"next_{s}")
        part = going.filter("NOT split_a AND NOT split_b").select("a", "b")
        rest = part if rest is None else rest.union(part)
        pairs = going.filter("split_a OR split_b")
    return rest, whole


def blocks(rows: DataFrame, folder: str) -> DataFrame:
    """(node, block, size, file, offset, length) of the blocks that the classes of each leaf are written as under ``folder``."""
    counts = rows.groupBy("node").agg(F.count("*").alias("m"))
    cut = attach(rows.select("node", "cid", "n", "dim", "vector"), counts, "node", "m", ["m"], F.col("cid"))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("cid"), F.ceil(F.col("m") / BLOCK)).cast("int")).repartition(F.col("node"), F.col("part")).sortWithinPartitions("node", "part")

    def written(batches: Iterator) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, out, at, key, held = uuid.uuid4().hex, None, 0, None, []

        def close() -> tuple:
            nonlocal out, at
            if out is None:
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            cid, n = (np.concatenate([np.asarray(x.column(c), np.int64) for x in held]) for c in ("cid", "n"))
            data = b"".join([np.array([len(cid), held[0].column("dim")[0].as_py()], np.int64).tobytes(), cid.tobytes(), n.tobytes(), *(v for x in held for v in x.column("vector").to_pylist())])
            out.write(data)
            at += len(data)
            return key[0], key[1], len(cid), name, at - len(data), len(data)

        def rows_() -> Iterator:
            nonlocal key, held
            for b in batches:
                keys = list(zip(b.column("node").to_pylist(), b.column("part").to_pylist()))
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
                for low, high in zip(cuts, cuts[1:]):
                    if keys[low] != key:
                        if held:
                            yield close()
                        key, held = keys[low], []
                    held.append(b.slice(low, high - low))
            if held:
                yield close()

        found = list(rows_())
        if out is not None:
            out.close()
        if found:
            types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["node", "block", "size", "file", "offset", "length"])

    return dealt.select("node", "part", "cid", "n", "dim", "vector").mapInArrow(written, "node string, block int, size long, file string, offset long, length long")


def block_pairs(rest: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of blocks to compare: columns of ``blocks`` with a_ and b_; of a leaf with itself each pair once."""
    a, b = (held.select(*[F.col(c).alias(f"{p}_{c}") for c in held.columns]) for p in "ab")
    pairs = rest.join(a, F.col("a") == F.col("a_node")).join(b, F.col("b") == F.col("b_node"))
    return pairs.filter((F.col("a") != F.col("b")) | (F.col("a_block") <= F.col("b_block")))


def compare(pairs: DataFrame, folder: str, kind: str, threshold: float) -> DataFrame:
    """(kind, a, b): kind 0 is a class and its links in one comparison, kind 1 a link."""

    def compared(batches: Iterator) -> Iterator:
        from collections import OrderedDict

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        cache: OrderedDict = OrderedDict()

        def load(file: str, offset: int, length: int):
            if (file, offset) in cache:
                cache.move_to_end((file, offset))
                return cache[file, offset]
            with store.open_input_file(f"{base}/{file}") as f:
                data = f.read_at(length, offset)
            size, dimension = np.frombuffer(data, np.int64, 2).tolist()
            cid, n = np.frombuffer(data, np.int64, size, 16), np.frombuffer(data, np.int64, size, 16 + 8 * size)
            raw = np.frombuffer(data, kind, size * dimension, 16 + 16 * size).reshape(size, dimension)
            wide = raw.astype(np.float64)
            norm = np.linalg.norm(wide, axis=1)
            cache[file, offset] = cid, n, raw, norm, (wide / norm[:, None]).astype(np.float32)
            if len(cache) > HELD:
                cache.popitem(last=False)
            return cache[file, offset]

        def rows() -> Iterator:
            for batch in batches:
                for fa, oa, la, fb, ob, lb in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                    same = (fa, oa) == (fb, ob)
                    mine, theirs = load(fa, oa, la), load(fb, ob, lb)
                    near = mine[4] @ theirs[4].T
                    mask = near >= threshold + MARGIN
                    i, j = np.nonzero((near >= threshold - MARGIN) & ~mask)
                    if len(i):
                        mask[i, j] = np.einsum("ij,ij->i", mine[2][i].astype(np.float64), theirs[2][j].astype(np.float64)) / (mine[3][i] * theirs[3][j]) >= threshold
                    if same:
                        np.fill_diagonal(mask, False)
                    if not mask.any():
                        continue
                    total = mask @ theirs[1]
                    yield from ((0, int(a), int(n)) for a, n in zip(mine[0][total > 0], total[total > 0]))
                    if not same:
                        back = mine[1] @ mask
                        yield from ((0, int(a), int(n)) for a, n in zip(theirs[0][back > 0], back[back > 0]))
                    yield from ((1, a, z) for a, z in forest(mask, mine[0], theirs[0]))

        def batch(out: list):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], names=["kind", "a", "b"])

        out = []
        for x in rows():
            out.append(x)
            if len(out) == 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    # the pairs of a block go to tasks by TOGETHER or so, whatever their number
    counts = pairs.groupBy("a_file", "a_offset").agg(F.count("*").alias("partners"))
    salt = F.pmod(F.xxhash64("b_file", "b_offset"), F.ceil(F.col("partners") / TOGETHER))
    dealt = pairs.join(counts, ["a_file", "a_offset"]).repartition(F.col("a_file"), F.col("a_offset"), salt).sortWithinPartitions("a_file", "a_offset", "b_file", "b_offset")
    return dealt.select("a_file", "a_offset", "a_length", "b_file", "b_offset", "b_length").mapInArrow(compared, "kind int, a long, b long")


def taken_whole(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """(kind, a, b) as ``compare`` gives it, for pairs of nodes whose vectors all link."""
    both = whole.union(whole.filter("of_a <> of_b OR k_a <> k_b").select("of_b", "k_b", "of_a", "k_a")).toDF("of", "k", "of_b", "k_b")
    asked = both.select("of", "k").distinct()
    # the classes below such nodes; a class has one node a level
    below = rows.select("cid", "n", F.explode("path").alias("p")).select("cid", "n", F.col("p.of").alias("of"), F.col("p.k").alias("k"))
    per = below.groupBy("of", "k").agg(F.count("*").alias("classes"), F.sum("n").alias("weight"), F.min("cid").alias("first"))
    per = per.join(asked, ["of", "k"])
    theirs = per.select(F.col("of").alias("of_b"), F.col("k").alias("k_b"), F.col("weight").alias("weight_b"), F.col("first").alias("first_b"))
    sums = both.join(theirs, ["of_b", "k_b"]).groupBy("of", "k").agg(F.sum("weight_b").alias("links"), F.max((F.col("of") == F.col("of_b")) & (F.col("k") == F.col("k_b"))).alias("own"))
    sums = sums.join(per, ["of", "k"]).select(F.struct("of", "k").alias("place"), "links", "own", "classes", "first")
    got = attach(below.select("cid", "n", F.struct("of", "k").alias("place")), sums, "place", "classes", ["links", "own", "first"], F.col("cid")).filter("links IS NOT NULL")
    # a class isn't linked with itself; its own copies are counted later
    degree = got.select(F.lit(0).alias("kind"), F.col("cid").alias("a"), (F.col("links") - F.when(F.col("own"), F.col("n")).otherwise(0)).alias("b"))
    star = got.select(F.lit(1), "cid", "first")
    across = both.join(per, ["of", "k"]).join(theirs, ["of_b", "k_b"]).select(F.lit(1), "first", "first_b")
    return degree.union(star).union(across)


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``; vectors link at a cosine of ``threshold`` or more."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    temporary: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        temporary.append(fresh(spark, name))
        return materialise(df, name, path=temporary[-1])

    v = F.col(quoted(vector_col))
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    finite = F.size(v) > 0
    finite = finite & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(quoted(id_col)).alias("id"), F.when(finite, v.cast(f"array<{'float' if single else 'double'}>")).alias("embedding"))
    kind = "<f4" if single else "<f8"
    classes = rows.filter("embedding IS NOT NULL").groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = kept(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "vector-classes")

    def packed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            data = [np.asarray(x.values, kind).tobytes() for x in b.column("embedding")]
            yield pa.record_batch([b.column("cid"), b.column("n"), b.column("dim"), pa.array(data, pa.binary())], names=["cid", "n", "dim", "vector"])

    slim = classes.select("cid", "n", "dim", "embedding").mapInArrow(packed, "cid long, n long, dim int, vector binary")
    if classes.isEmpty():
        found = spark.createDataFrame([], "kind int, a long, b long")
    else:
        at_leaf, trees, subtrees = grow(kept(slim, "vectors"), kind, threshold, temporary)
        at_leaf = kept(at_leaf, "leaves")
        rest, whole = candidates(at_leaf, trees, subtrees, threshold, temporary)
        folder = fresh(spark, "blocks")
        temporary.append(folder)
        pairs = block_pairs(rest, kept(blocks(at_leaf, folder), "block-index"))
        found = kept(compare(pairs, folder, kind, threshold).union(taken_whole(at_leaf, whole)), "compared")
    links = found.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    comps = connected_components(found.filter("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    table = classes.join(links, classes.cid == links.a, "left").join(comps, classes.cid == comps.node, "left")
    table = kept(table.select("embedding", "rep", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")), "linked")
    # the smallest id of each component
    first = table.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("m"))
    table = attach(table, first.filter("m > 1"), "component", "m", ["component_id", "m"], F.col("embedding"))
    table = table.withColumn("component_id", F.when(F.col("m").isNull(), F.col("rep")).otherwise(F.col("component_id")))
    path = fresh(spark, "placed")
    table = materialise(table.select("embedding", "n", "n_links", "component_id"), "placed", path=path)
    leave(spark, path)
    for t in temporary:
        remove(spark, t)
    out = attach(rows, table, "embedding", "n", ["n_links", "component_id"], F.col("id"))
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
