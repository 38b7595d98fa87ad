"""The file formats as Spark data sources, and the functions that read them into DataFrames.

``read_features`` gives one row per feature of a file or a folder of files; its work is dealt out by file, record range or key
range. An extent is passed to the source as an option, so each format filters by its own rules before anything reaches Spark:
GeoJSON by the geometry's bounds or else the declared box of the feature; Shapefile by the declared box of the record and then by the
actual bounds; GeoPackage by its index alone if it has one. An invalid extent raises.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema as S
from ..functions import crs as C, wkt as W
from ..functions.probe import resolve
from ..operators.viewport import ByteCache
from . import files, geojson, geopackage, geometry as G, geotiff, shapefile, worldimage

#: Records or rows in a partition, and rows in an Arrow batch.
PARTITION_ROWS = 50_000
BATCH_ROWS = 2000
#: Bytes of a SHP file in a partition, by the mean length of its records, and records at most. Records are decoded in chunks, so a partition's memory doesn't grow with
#: its rows; every partition is a task that may write files.
PARTITION_BYTES, MOST_ROWS = 32 << 20, 500_000
#: A GeoJSON file longer than this is dealt out in chunks of this size.
SPLIT_BYTES = 4 << 20
EXTENSIONS = {"geojson": (".geojson", ".json"), "shapefile": (".shp",), "geopackage": (".gpkg",), "geotiff": (".tif", ".tiff"), "worldimage": (".png", ".jpg", ".jpeg")}


class Part(InputPartition):
    def __init__(self, path: str, layer: str | None = None, first=None, last=None) -> None:
        super().__init__(path)
        self.path, self.layer, self.first, self.last = path, layer, first, last


def _paths(path: str, fmt: str) -> list[str]:
    return files.expand(path, EXTENSIONS[fmt])


def _geojson_rows(part: Part, extent) -> Iterator[tuple]:
    try:
        if part.first is None:
            found, first = geojson.features(geojson.parse(files.read(part.path).decode("utf-8-sig"), part.path)), 0
        else:
            start, end, first = part.first
            text = files.read(part.path, start, end - start).decode("utf-8")
            found = [geojson.feature(f) for f in geojson.parse(f"[{text}]", part.path)]
    except G.Malformed as error:
        raise G.Malformed(f"{part.path}: {error}") from error
    for seq, (id, geometry, declared, attributes) in enumerate(found, first):
        own = G.bounds(geometry)
        of = own or (declared and (declared["minx"], declared["miny"], declared["maxx"], declared["maxy"]))
        if extent is None or G.intersects(of, extent):
            yield files.stem(part.path), seq, id, geometry, declared, own, attributes


#: Records, and bytes of them, that a task decodes at once.
CHUNK_ROWS, CHUNK_BYTES = 10_000, 8 << 20


def _chunks(part: Part, lengths) -> Iterator[tuple[int, int]]:
    """Ranges of the partition's records of at most CHUNK_ROWS rows and, but for a single record, CHUNK_BYTES."""
    import numpy as np

    ends, a = np.cumsum(lengths), 0
    while a < len(lengths):
        most = CHUNK_BYTES + (ends[a - 1] if a else 0)
        b = max(a + 1, min(a + CHUNK_ROWS, int(np.searchsorted(ends, most, "right"))))
        yield a, b
        a = b


def _shapefile_batches(part: Part, extent) -> Iterator:
    """Arrow batches (columns of ``schema.FEATURE``) of a range of records."""
    import pyarrow as pa

    from . import shapecolumns

    kit = shapefile.sidecars(part.path)
    index = shapecolumns.entries(files.read(kit["shx"], 100 + 8 * part.first, 8 * (part.last - part.first)))
    head = _table(kit["dbf"])
    codec = shapefile.encoding(files.read(kit["cpg"]).decode("latin-1") if kit["cpg"] else None, head.language)
    arrow = S.arrow_schema(S.FEATURE)
    with files.opened(kit["shp"]) as shapes, files.opened(kit["dbf"]) as table:
        for a, b in _chunks(part, index[:, 1] + 8):
            at, lengths = index[a:b, 0], index[a:b, 1]
            first, low, high = part.first + a, int(at.min()), int((at + 8 + lengths).max())
            if high - low > 2 * int((lengths + 8).sum()) + CHUNK_BYTES:  # records far apart
                data = b"".join(shapes(int(o), 8 + int(n)).ljust(8 + int(n), b"\0") for o, n in zip(at, lengths))
                at = np.cumsum(lengths + 8) - lengths - 8
            else:
                data, at = shapes(low, high - low), at - low
            found = shapecolumns.decode(data, at, lengths, first + 1, extent)
            rows = table(head.start + head.width * first, head.width * (b - a))
            if found is None:  # record by record, up to the one that is wrong
                yield from feature_batches(_shapefile_rows(part.path, first, data, at.tolist(), lengths.tolist(), rows, head, codec, extent))
                continue
            kept, geometry, declared, sides = found
            raw, there = shapecolumns.records(rows, head, b - a)
            raw, there = raw[kept], there[kept]
            if not there.all():
                alive = pa.array(there)
                kept, raw, geometry, declared, sides = kept[there], raw[there], geometry.filter(alive), declared.filter(alive), [s.filter(alive) for s in sides]
            if len(kept):
                seq = pa.array(kept + first)
                id = pa.array(kept + first + 1).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([files.stem(part.path)] * len(kept)), seq, id, geometry, declared, *sides, shapecolumns.as_json(raw, head, codec)], schema=arrow)


def _shapefile_rows(path: str, first: int, shapes: bytes, at: list[int], lengths: list[int], rows: bytes, head: shapefile.Table, codec: str, extent) -> Iterator[tuple]:
    from .shapecolumns import _dumped

    for k, (offset, length) in enumerate(zip(at, lengths)):
        content = shapefile.record(shapes[offset : offset + 8 + length], first + k + 1, length)
        if extent is not None and not G.intersects(G.shape_bounds(content[:36]), extent):
            continue
        geometry = G.shape(content)
        own = G.bounds(geometry)
        if extent is not None and not G.intersects(own, extent):
            continue
        values = shapefile.row(rows[k * head.width : (k + 1) * head.width], head, codec)
        if values is not None:
            text = "{" + ",".join(json.dumps(n, ensure_ascii=False) + ":" + _dumped(v) for n, v in values.items()) + "}"
            declared = geometry["members"][0]["declared"] if geometry and geometry["members"] else None
            yield files.stem(path), first + k, str(first + k + 1), geometry, declared, own, text


def _geopackage_rows(part: Part, extent) -> Iterator[tuple]:
    keys = None if part.first is None else (part.first, part.last)
    with geopackage.Package(part.path) as p:
        for seq, (key, geometry, declared, row) in enumerate(p.rows(part.layer, keys, extent)):
            yield part.layer, seq if keys is None else key, None if key is None else str(key), geometry, declared, G.bounds(geometry), geopackage.as_json(row)


_ROWS = {"geojson": _geojson_rows, "geopackage": _geopackage_rows}


def _batches(rows: Iterator[dict], schema: str):
    import itertools

    import pyarrow as pa

    arrow = S.arrow_schema(schema)
    while chunk := list(itertools.islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_pylist(chunk, schema=arrow)


def feature_batches(rows: Iterator[tuple]):
    """Arrow batches (columns of ``schema.FEATURE``) of (layer, seq, id, geometry, declared box, bounds, attributes)."""
    import itertools

    import pyarrow as pa

    arrow = S.arrow_schema(S.FEATURE)
    kinds = {f.name: f.type for f in arrow}
    while chunk := list(itertools.islice(rows, BATCH_ROWS)):
        layer, seq, id, geometry, declared, own, attributes = zip(*chunk)
        sides = zip(*(o or (None,) * 4 for o in own))
        yield pa.RecordBatch.from_arrays([pa.array(layer, pa.string()), pa.array(seq, pa.int64()), pa.array(id, pa.string()), G.as_array(geometry, kinds["geometry"]), pa.array(declared, kinds["declared_bounds"]), *(pa.array(v, pa.float64()) for v in sides), pa.array(attributes, pa.string())], schema=arrow)


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.fmt, self.path, self.layer = options["kind"], options["path"], options.get("layer")
        self.extent = tuple(map(float, options["extent"].split(","))) if options.get("extent") else None
        self.ranges = json.loads(options.get("ranges", "{}"))

    def partitions(self) -> list[Part]:
        out = []
        for path in _paths(self.path, self.fmt):
            if self.fmt == "geopackage":
                with geopackage.Package(path) as p:
                    for x in p.layers():
                        if self.layer in (None, x["layer"]):
                            # a file that has to be copied is copied for one task a layer, not for each range
                            ranges = [None] if geopackage.remote(path) else p.ranges(x["layer"], PARTITION_ROWS)
                            out += [Part(path, x["layer"], *(r or (None, None))) for r in ranges]
            elif self.layer in (None, files.stem(path)):
                if self.fmt == "geojson":
                    out += [Part(path, None, tuple(r)) for r in self.ranges[path]] if path in self.ranges else [Part(path)]
                else:
                    kit = shapefile.sidecars(path)
                    shapefile.header(files.read(path, 0, 100))
                    body = files.size(kit["shx"]) - 100
                    if body % 8:
                        raise G.Malformed("an SHX index ends inside an entry")
                    n = body // 8
                    if _table(kit["dbf"]).rows != n:
                        raise G.Malformed(f"{path}: the SHX index and the DBF table have different numbers of records")
                    # ranges of equal numbers, so that the last is no small rest
                    parts = max(1, -(-files.size(path) // PARTITION_BYTES), -(-n // MOST_ROWS))
                    ends = [n * k // parts for k in range(parts + 1)]
                    out += [Part(path, None, a, b) for a, b in zip(ends, ends[1:]) if a < b]
        if not out and self.layer is not None:
            raise ValueError(f"no layer {self.layer} in {self.path}")
        return out or [Part("")]

    def read(self, part: Part):
        if part.path:
            yield from _shapefile_batches(part, self.extent) if self.fmt == "shapefile" else feature_batches(_ROWS[self.fmt](part, self.extent))


class FeatureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terraframe_features"

    def schema(self) -> str:
        return S.FEATURE

    def reader(self, schema) -> FeatureReader:
        return FeatureReader(dict(self.options))


class BlockReader(DataSourceReader):
    """Blocks of a GeoTIFF directory or of a PNG as rows; only those that the window touches are partitions at all."""

    BLOCKS = 64

    def __init__(self, options: dict) -> None:
        self.path, self.level = options["path"], int(options.get("level", 0))
        self.window = tuple(map(int, options["window"].split(","))) if options.get("window") else None

    def partitions(self) -> list[Part]:
        if resolve(self.path) == "worldimage":
            return [Part(self.path)]
        with files.opened(self.path) as fetch:
            d = geotiff.directories(fetch)[self.level]
        # a partition carries what its tasks need: the tags, and where its blocks lie
        found = [(*x, d.places(x[0])) for x in geotiff.blocks(d, self.window)]
        return [Part(self.path, None, found[i : i + self.BLOCKS], d.slim()) for i in range(0, len(found), self.BLOCKS)]

    def read(self, part: Part):
        if part.first is None:
            pixels = worldimage.png(files.read(part.path))
            yield 0, 0, 0, pixels.shape[1], pixels.shape[0], pixels.tobytes()
            return
        with files.opened(part.path) as fetch:
            for number, x, y, w, h, places in part.first:
                pixels = geotiff.block(part.last, [fetch(*p) for p in places], w, h)
                yield number, x, y, w, h, pixels.tobytes()


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terraframe_blocks"

    def schema(self) -> str:
        return "block int, x int, y int, w int, h int, pixels binary"

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))


def _table(path: str) -> shapefile.Table:
    return shapefile.table(files.read(path, 0, 32 + 32 * 256 + 1))


class TableReader(DataSourceReader):
    def __init__(self, path: str, schema) -> None:
        self.path, self.kind = path, schema

    def partitions(self) -> list[Part]:
        out, known = [], None
        for path in files.expand(self.path, (".dbf",)):
            t = _table(path)
            if known is not None and t.fields != known:
                raise G.Malformed(f"{path}: its fields differ from those of the other tables of {self.path}")
            known = t.fields
            out += [Part(path, None, a, min(t.rows, a + PARTITION_ROWS)) for a in range(0, t.rows, PARTITION_ROWS)]
        return out or [Part("")]

    def read(self, part: Part):
        if not part.path:
            return
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from . import shapecolumns

        arrow = to_arrow_schema(self.kind)
        head = _table(part.path)
        cpg = files.sidecar(part.path, ".cpg")
        codec = shapefile.encoding(files.read(cpg).decode("latin-1") if cpg else None, head.language)
        step = max(1, min(CHUNK_ROWS, CHUNK_BYTES // head.width))
        with files.opened(part.path) as fetch:
            for first in range(part.first, part.last, step):
                n = min(step, part.last - first)
                raw, there = shapecolumns.records(fetch(head.start + head.width * first, head.width * n), head, n)
                columns = shapecolumns.as_columns(raw[there], head, codec, arrow.types[2:])
                if not there.all():
                    row = pa.array(np.cumsum(there) - 1, mask=~there)
                    columns = [c.take(row) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.array(~there), *columns], schema=arrow)


class TableSource(DataSource):
    """A DBF table, or all of a folder, with typed columns, the record number in its file and whether the record is deleted."""

    @classmethod
    def name(cls) -> str:
        return "terraframe_dbf"

    def schema(self) -> str:
        types = {"C": "string", "L": "boolean", "D": "date", "I": "int", "Y": "decimal(19,4)"}
        out = ["record_no long", "deleted boolean"]
        found = files.expand(self.options["path"], (".dbf",))
        if not found:
            raise ValueError(f"no DBF table in {self.options['path']}")
        for f in _table(found[0]).fields:
            number = "long" if f.decimals == 0 else f"decimal({min(38, max(f.length, f.decimals + 1))},{f.decimals})"
            if f.kind not in (*types, "N", "F"):
                raise G.Unsupported(f"DBF field type {f.kind}")
            out.append(f"`{f.name}` {types.get(f.kind, number)}")
        return ", ".join(out)

    def reader(self, schema) -> TableReader:
        return TableReader(self.options["path"], schema)


#: Ranges found, by path, length, time of change and size of chunks; the last 64.
_FOUND: dict[tuple, tuple | None] = {}


def _ranges(spark: SparkSession, path: str) -> tuple[list[tuple[int, int, int]], dict] | None:
    """``_sought`` once for a file as it is."""
    key = (path, *files.version(path), SPLIT_BYTES)
    if key not in _FOUND:
        while len(_FOUND) >= 64:
            _FOUND.pop(next(iter(_FOUND)))
        _FOUND[key] = _sought(spark, path)
    return _FOUND[key]


def _sought(spark: SparkSession, path: str) -> tuple[list[tuple[int, int, int]], dict] | None:
    """([(from byte, to byte, number of the first feature)], the document without its features) of a large GeoJSON file.

    Tasks summarise chunks of the file without knowing how they begin; put together, the summaries say how each begins, and tasks look for
    the features then. None if no feature array is found in that way; such a document is parsed whole.
    """
    total = files.size(path)
    starts = [(at, min(total, at + SPLIT_BYTES)) for at in range(0, total, SPLIT_BYTES)]
    chunks = spark.createDataFrame([(i, *s) for i, s in enumerate(starts)], "i int, low long, high long").repartition(len(starts), "i")

    def summarised(batches):
        import pyarrow as pa

        for b in batches:
            for i, low, high in zip(*(b.column(c).to_pylist() for c in ("i", "low", "high"))):
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([json.dumps(geojson.summary(files.read(path, low, high - low)))])], names=["i", "found"])

    # a few numbers for each chunk
    sums = {r["i"]: json.loads(r["found"]) for r in chunks.mapInArrow(summarised, "i int, found string").collect()}
    state, begins = (0, 0, 0), []
    for i, (low, high) in enumerate(starts):
        begins.append((i, low, high, *state))
        inside, escaped, depth = sums[i][2 * state[0] + state[1]]
        state = inside, escaped, state[2] + depth
    known = spark.createDataFrame(begins, "i int, low long, high long, inside int, escaped int, depth int").repartition(len(starts), "i")

    def sought(batches):
        import pyarrow as pa

        for b in batches:
            for i, low, high, inside, escaped, depth in zip(*(b.column(c).to_pylist() for c in b.schema.names)):
                found = geojson.landmarks(files.read(path, low, min(total, high + geojson.AHEAD) - low), high - low, inside, escaped, depth)
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([json.dumps([[low + x for x in xs] for xs in found])])], names=["i", "found"])

    # per chunk the few places where a feature array or the outermost level ends or begins
    arrays, ends = [], []
    for r in known.mapInArrow(sought, "i int, found string").collect():
        found = json.loads(r["found"])
        arrays += found[0]
        ends += found[1]
    if not arrays:
        return None
    first = max(arrays)
    last = min((e for e in ends if e >= first), default=None)
    if last is None:
        return None

    def elements(batches):
        import pyarrow as pa

        for b in batches:
            for i, low, high, inside, escaped, depth in zip(*(b.column(c).to_pylist() for c in b.schema.names)):
                at = geojson.elements(files.read(path, low, high - low), inside, escaped, depth)
                at = at[(at + low >= first) & (at + low < last)]
                if len(at):
                    yield pa.record_batch([pa.array([low + int(at[0])], pa.int64()), pa.array([len(at)], pa.int64())], names=["start", "n"])

    cuts = sorted((r["start"], r["n"]) for r in known.mapInArrow(elements, "start long, n long").collect())
    out, seq = [], 0
    for k, (start, n) in enumerate(cuts):
        end = cuts[k + 1][0] if k + 1 < len(cuts) else last
        begin = start if k else first
        out.append((begin, end, seq))
        seq += n
    skeleton = files.read(path, 0, first).decode("utf-8-sig") + files.read(path, last).decode()
    root = geojson.parse(skeleton, path)
    if not isinstance(root, dict) or root.get("type") != "FeatureCollection":
        return None
    # the comma before the next range's first feature isn't this one's
    return [(a, _before_comma(path, a, b) if k + 1 < len(out) else b, n) for k, (a, b, n) in enumerate(out)] or [(first, last, 0)], root


def _before_comma(path: str, low: int, high: int) -> int:
    """Where what lies before the comma and the spaces in front of ``high`` ends."""
    step = 64
    while True:
        at = max(low, high - step)
        tail = files.read(path, at, high - at).rstrip()
        if tail[-1:] == b",":
            return at + len(tail) - 1
        if tail or at == low:
            raise G.Malformed(f"{path} is not valid JSON: a comma is missing between features")
        step *= 16


def register(spark: SparkSession) -> None:
    for source in (FeatureSource, BlockSource, TableSource):
        spark.dataSource.register(source)


def read_features(spark: SparkSession, path: str, *, layer: str | None = None, extent: tuple[float, float, float, float] | None = None, format: str | None = None) -> DataFrame:
    """One row per feature (columns of ``schema.FEATURE``); ``attributes`` is JSON, see ``with_variant``."""
    register(spark)
    options = {"path": path, "kind": format or resolve(path)}
    if layer is not None:
        options["layer"] = layer
    if options["kind"] == "geojson":
        ranges = {p: r[0] for p in _paths(path, "geojson") if files.size(p) > SPLIT_BYTES and (r := _ranges(spark, p)) is not None}
        options["ranges"] = json.dumps(ranges)
    if extent is not None:
        if not (extent[0] <= extent[2] and extent[1] <= extent[3]):
            raise ValueError("the extent is invalid")
        options["extent"] = ",".join(repr(float(v)) for v in extent)
    return spark.read.format("terraframe_features").options(**options).load()


def with_variant(features: DataFrame) -> DataFrame:
    """The attributes as a variant: whole numbers, decimals, doubles, texts, lists and objects as they were."""
    return features.withColumn("attributes", F.parse_json("attributes"))


def read_dbf(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a DBF table, or of all tables of a folder, which must have the same fields."""
    register(spark)
    return spark.read.format("terraframe_dbf").option("path", path).load()


def read_blocks(spark: SparkSession, path: str, *, level: int = 0, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("terraframe_blocks").option("path", path).option("level", level)
    return (reader.option("window", ",".join(map(str, window))) if window else reader).load()


_JPEG = (".jpg", ".jpeg")


def _from_image_source(image: dict):
    """Pixels (h, w, 4) of a row of Spark's image source: rows of blue, green and red, or of gray, and perhaps alpha."""
    import numpy as np

    h, w, n = image["height"], image["width"], image["nChannels"]
    a = np.frombuffer(image["data"], np.uint8).reshape(h, w, n)
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = a if n == 1 else a[..., 2::-1]
    if n == 4:
        out[..., 3] = a[..., 3]
    return out


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, w, h, pixels): every image with a world file of a folder as one block, decoded by tasks; JPEG by Spark's image source."""
    found = _paths(path, "worldimage")
    kind = "path string, x int, y int, w int, h int, pixels binary"
    jpeg = [p for p in found if p.lower().endswith(_JPEG)]
    paths = spark.createDataFrame([(p,) for p in found if p not in jpeg], "path string")

    def decoded(batches):
        import pyarrow as pa

        for b in batches:
            for p in b.column("path").to_pylist():
                a = worldimage.png(files.read(p))
                yield pa.record_batch([pa.array([p]), *(pa.array([n], pa.int32()) for n in (0, 0, a.shape[1], a.shape[0])), pa.array([a.tobytes()], pa.binary())], names=["path", "x", "y", "w", "h", "pixels"])

    out = paths.repartition(F.col("path")).mapInArrow(decoded, kind)
    if jpeg:

        def turned(batches):
            import pyarrow as pa

            for b in batches:
                for p, image in zip(b.column("path").to_pylist(), b.column("image").to_pylist()):
                    a = _from_image_source(image)
                    yield pa.record_batch([pa.array([p]), *(pa.array([n], pa.int32()) for n in (0, 0, a.shape[1], a.shape[0])), pa.array([a.tobytes()], pa.binary())], names=["path", "x", "y", "w", "h", "pixels"])

        # the source names files by URI; the paths are those that were asked for
        names = F.create_map(*[F.lit(x) for p in jpeg for x in (files.stem(p), p)])
        images = spark.read.format("image").load(jpeg).select(names[F.regexp_extract("image.origin", r"([^/]+)\.[^./]+$", 1)].alias("path"), "image")
        out = out.union(images.mapInArrow(turned, kind))
    return out


def pixels(blocks: DataFrame) -> DataFrame:
    """(px, py, r, g, b, a): the pixels of blocks."""

    def spread(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for x, y, w, h, data in zip(*(b.column(c).to_pylist() for c in ("x", "y", "w", "h", "pixels"))):
                a = np.frombuffer(data, np.uint8).reshape(-1, 4).astype(np.int32)
                ys, xs = np.divmod(np.arange(w * h, dtype=np.int32), w)
                yield pa.record_batch([pa.array(xs + x), pa.array(ys + y), *(pa.array(a[:, k]) for k in range(4))], names=["px", "py", "r", "g", "b", "a"])

    return blocks.mapInArrow(spread, "px int, py int, r int, g int, b int, a int")



def vector_layers(spark: SparkSession, path: str, *, format: str | None = None) -> DataFrame:
    """Metadata of every layer (columns of ``schema.VECTOR_LAYER``), one task per file."""
    fmt = format or resolve(path)
    register(spark)
    # a large GeoJSON file is described from its features
    large = [p for p in _paths(path, fmt) if fmt == "geojson" and files.size(p) > SPLIT_BYTES and _ranges(spark, p) is not None]
    paths = spark.createDataFrame([(p,) for p in _paths(path, fmt) if p not in large], "path string")
    raw = "path string, source_kind string, layer string, authority string, code string, wkt string, name string, minx double, miny double, maxx double, maxy double, geometry_type string, feature_count long"

    def described(batches):
        for b in batches:
            for p in b.column("path").to_pylist():
                yield from _batches(iter(_describe(p, fmt)), raw)

    found = paths.repartition(F.col("path")).mapInArrow(described, raw)
    for p in large:
        found = found.union(_large_geojson(spark, p, raw))
    own = C.make(F.col("authority"), F.col("code"), F.col("wkt"), F.col("name"))
    crs = F.when(F.col("authority").isNull() & F.col("wkt").isNotNull(), C.parse_wkt(F.col("wkt"))).otherwise(own)
    box = F.when(F.col("minx").isNotNull(), F.struct("minx", "miny", "maxx", "maxy"))
    return found.select("path", "source_kind", "layer", crs.alias("crs"), box.alias("bounds"), "geometry_type", "feature_count")


def _large_geojson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``_describe`` gives, summed over the features; the declared box and the reference system are the root's."""
    _, root = _ranges(spark, path)
    whole, crs = geojson.declared(root), geojson.crs(root)
    f = read_features(spark, path, format="geojson")
    side = lambda s: F.coalesce(F.col(s), F.col("declared_bounds")[s])
    box = [F.lit(whole[s]) if whole else (F.min if s[:3] == "min" else F.max)(side(s)) for s in ("minx", "miny", "maxx", "maxy")]
    kinds = F.collect_set("geometry.type")  # seven at most
    values = [F.lit(path), F.lit("geojson"), F.lit(files.stem(path)), *(F.lit(crs[k]).cast("string") for k in ("authority", "code", "wkt", "name")), *box, F.when(F.size(kinds) == 1, kinds[0]), F.count("*")]
    names = [x.split()[0] for x in schema.split(", ")]
    return f.agg(*[v.alias(n) for v, n in zip(values, names)]).select(*[F.col(n).cast(x.split()[1]) for n, x in zip(names, schema.split(", "))])


def _describe(path: str, fmt: str) -> list[dict]:
    blank = {"path": path, "source_kind": fmt, "layer": files.stem(path), "authority": None, "code": None, "wkt": None, "name": None, "minx": None, "miny": None, "maxx": None, "maxy": None, "geometry_type": None}
    sides = ("minx", "miny", "maxx", "maxy")
    if fmt == "geojson":
        root = geojson.parse(files.read(path).decode("utf-8-sig"), path)
        found = geojson.features(root)
        boxes = [b for _, g, d, _ in found if (b := G.bounds(g) or (d and tuple(d[s] for s in sides)))]
        whole = geojson.declared(root)
        kinds = {g["type"] for _, g, _, _ in found if g}
        if whole:
            box = {s: whole[s] for s in sides}
        elif boxes:
            box = dict(zip(sides, (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))))
        else:
            box = {}
        return [blank | geojson.crs(root) | box | {"geometry_type": kinds.pop() if len(kinds) == 1 else None, "feature_count": len(found)}]
    if fmt == "shapefile":
        from ..functions.geometry import SHAPE_KINDS

        kit = shapefile.sidecars(path)
        head = shapefile.header(files.read(path, 0, 100))
        wkt = files.read(kit["prj"]).decode("utf-8", "replace").strip() if kit["prj"] else None
        if wkt == "":
            raise G.Malformed(f"{kit['prj']} is empty")
        return [blank | {"wkt": wkt} | dict(zip(sides, head.bounds)) | {"geometry_type": SHAPE_KINDS.get(head.shape_type), "feature_count": (files.size(kit["shx"]) - 100) // 8}]
    from ..functions.geometry import NAMED_KINDS

    out = []
    with geopackage.Package(path) as p:
        for x in p.layers():
            text = (x["definition"] or "").strip()
            out.append(
                blank
                | {"layer": x["layer"], "authority": x["organization"], "code": str(x["code"]) if x["code"] and x["code"] > 0 else None, "wkt": text if text and text.lower() != "undefined" else None, "name": x["name"]}
                | {s: x[s] for s in sides}
                | {"geometry_type": NAMED_KINDS.get((x["kind"] or "").upper()), "feature_count": p.count(x["layer"])}
            )
    return out


def raster_layers(spark: SparkSession, path: str, *, format: str | None = None) -> DataFrame:
    """Metadata of rasters (columns of ``schema.RASTER_LAYER``), one task per file."""
    fmt = format or resolve(path)
    paths = spark.createDataFrame([(p,) for p in _paths(path, fmt)], "path string")

    def described(batches):
        for b in batches:
            yield from _batches((_describe_raster(p, fmt) for p in b.column("path").to_pylist()), S.RASTER_LAYER)

    return paths.repartition(F.col("path")).mapInArrow(described, S.RASTER_LAYER)


def _corner_box(t: tuple | None, w: int, h: int) -> dict | None:
    if t is None:
        return None
    ox, a, b, oy, d, e = t
    xs, ys = [ox + c * a + r * b for c in (0, w) for r in (0, h)], [oy + c * d + r * e for c in (0, w) for r in (0, h)]
    return {"minx": min(xs), "miny": min(ys), "maxx": max(xs), "maxy": max(ys)}


def _wkt_crs(wkt: str | None) -> dict:
    if wkt is None or not wkt.strip():
        return {"authority": None, "code": None, "wkt": None, "name": None}
    authority, code, name = W.read(wkt)
    return {"authority": authority, "code": code, "wkt": wkt, "name": name}


def _describe_raster(path: str, fmt: str) -> dict:
    blank = {"path": path, "source_kind": fmt, "layer": "raster"}
    if fmt == "worldimage":
        with files.opened(path) as fetch:
            w, h, n = worldimage.header(fetch)
        world, prj = worldimage.world_file(path), files.sidecar(path, ".prj")
        t = worldimage.affine(files.read(world).decode("latin-1")) if world else None
        colors = {1: ["Gray"], 2: ["Gray", "Alpha"], 3: ["Red", "Green", "Blue"], 4: ["Red", "Green", "Blue", "Alpha"]}[n]
        bands = [{"idx": i + 1, "sample_type": "UnsignedInteger", "bits": 8, "color": c, "nodata": None} for i, c in enumerate(colors)]
        crs = _wkt_crs(files.read(prj).decode("utf-8", "replace") if prj else None)
        return blank | {"crs": crs, "bounds": _corner_box(t, w, h), "width": w, "height": h, "band_count": n, "geotransform": dict(zip(("ox", "a", "b", "oy", "d", "e"), t)) if t else None, "pixel_anchor": "Area", "bands": bands, "overviews": [], "color_model": {1: "Gray", 2: "GrayAlpha", 3: "RGB", 4: "RGBA"}[n], "is_tiled": False}
    from ..functions.raster import COLOR_MODELS

    with files.opened(path) as fetch:
        all_ = geotiff.directories(fetch)
    d = all_[0]
    (w, h), keys = d.size, geotiff.geokeys(d)
    anchor = "Point" if keys.get(geotiff.RASTER_TYPE) == 2 else "Area"
    m, s, tie = (d.tags.get(k, ()) for k in (geotiff.MATRIX, geotiff.SCALE, geotiff.TIEPOINT))
    t = None
    if len(m) >= 16:
        t = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif len(s) >= 2 and len(tie) >= 6:
        t = (tie[3] - tie[0] * s[0], s[0], 0.0, tie[4] + tie[1] * s[1], 0.0, -s[1])
    if t and anchor == "Point":
        t = (t[0] - (t[1] + t[2]) / 2, t[1], t[2], t[3] - (t[4] + t[5]) / 2, t[4], t[5])
    code = next((keys[k] for k in (geotiff.PROJECTED, geotiff.GEOGRAPHIC) if keys.get(k) not in (None, 0, 32767)), None)
    cite = next((keys[k] for k in (geotiff.PROJECTED_NAME, geotiff.GEOGRAPHIC_NAME) if str(keys.get(k, "")).strip()), None)
    crs = {"authority": "EPSG" if code else None, "code": str(code) if code else None, "wkt": None, "name": f"EPSG:{code}" if code else cite}
    n, photometric = d.one(geotiff.SAMPLES, 1), d.one(geotiff.PHOTOMETRIC, 1)
    try:
        nodata = float(d.one(geotiff.NODATA, "").rstrip("\0").strip())
    except ValueError:
        nodata = None
    kind = {1: "UnsignedInteger", 2: "SignedInteger", 3: "FloatingPoint"}.get(d.one(geotiff.FORMAT, 1), "Unknown")

    def color(i: int) -> str:
        if photometric in (0, 1):
            return "Alpha" if i else "Gray"
        if photometric in (2, 6):
            return ("Red", "Green", "Blue")[i] if i < 3 else "Alpha" if i == n - 1 else "Unknown"
        return "Palette" if photometric == 3 and i == 0 else "Unknown"

    bands = [{"idx": i + 1, "sample_type": kind, "bits": d.one(geotiff.BITS, 1), "color": color(i), "nodata": nodata} for i in range(n)]
    over = [{"level": k, "w": x, "h": y, "decx": dx, "decy": dy} for k, x, y, dx, dy in geotiff.overviews(all_)]
    return blank | {"crs": crs, "bounds": _corner_box(t, w, h), "width": w, "height": h, "band_count": n, "geotransform": dict(zip(("ox", "a", "b", "oy", "d", "e"), t)) if t else None, "pixel_anchor": anchor, "bands": bands, "overviews": over, "color_model": COLOR_MODELS.get(photometric, f"TIFF Photometric {photometric}"), "is_tiled": d.tiled}


#: Decoded images that the driver keeps for viewports, by path, length and time of change.
DECODED = ByteCache(256 << 20)


def decoded_image(path: str):
    """Pixels (h, w, 4) of a PNG or JPEG, kept for the next read unless the file changes."""
    key = (path, *files.version(path))
    found = DECODED.get(key)
    if found is None:
        if path.lower().endswith(_JPEG):
            spark = SparkSession.getActiveSession()
            if spark is None:
                raise G.Unsupported("JPEG pixels without a Spark session")
            found = _from_image_source(spark.read.format("image").load(path).first()["image"].asDict())
        else:
            found = worldimage.png(files.read(path))
        DECODED.set(key, found, found.nbytes)
    return found


def read_window(path: str, window: tuple[int, int, int, int], out_w: int, out_h: int, wanted=lambda: True) -> tuple[int, tuple[int, int, int, int], bytes]:
    """(level, clipped window, RGBA bytes) of a raster file, for a viewport; ``wanted`` says whether anybody still waits for it."""
    if resolve(path) == "geotiff":
        with files.opened(path) as fetch:
            level, clipped, out = geotiff.read_window(fetch, geotiff.directories(fetch), window, out_w, out_h, wanted)
        return level, clipped, out.tobytes()
    x, y, w, h = window
    if x < 0 or y < 0 or w <= 0 or h <= 0:
        raise ValueError("the window is invalid")
    image = decoded_image(path)
    if not wanted():
        raise geotiff.Cancelled
    w, h = min(x + w, image.shape[1]) - x, min(y + h, image.shape[0]) - y
    if w <= 0 or h <= 0:
        raise ValueError("the window is outside the raster")
    return 0, (x, y, w, h), geotiff.nearest(image[y : y + h, x : x + w], out_w, out_h).tobytes()
