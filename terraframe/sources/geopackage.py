"""GeoPackage: catalogue, layers, key ranges and rows by the sqlite3 of Python, read-only; and a writer for fixtures and exports."""

from __future__ import annotations

import atexit
import base64
import json
import math
import os
import sqlite3
import tempfile

from . import files
from .geometry import Malformed, bounds, gpkg_blob, intersects, to_gpkg_blob

#: Fixed value: application_id of the format, the letters GPKG.
APPLICATION_ID = 0x47504B47


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


#: Copies that this process has made of files in other stores, by path, length and time of change.
_COPIES: dict[tuple, str] = {}


def remote(path: str) -> bool:
    """Whether sqlite can't open the file where it lies."""
    return files.store(path)[0].type_name != "local"


def _copied(path: str) -> str:
    """A temporary copy of a file in another store, made once by a process, piece by piece, and deleted when it ends."""
    key = (path, *files.version(path))
    if key not in _COPIES:
        handle, copy = tempfile.mkstemp(suffix=".gpkg")
        atexit.register(lambda: os.path.exists(copy) and os.unlink(copy))
        with os.fdopen(handle, "wb") as f, files.opened(path) as fetch:
            at = 0
            while piece := fetch(at, 8 << 20):
                f.write(piece)
                at += len(piece)
        _COPIES[key] = copy
    return _COPIES[key]


class Package:
    """An open GeoPackage. A file in a store that sqlite can't open is read from a copy."""

    def __init__(self, path: str) -> None:
        store, at = files.store(path)
        local = at
        if store.type_name != "local":
            local = _copied(path)
        elif not os.path.exists(at):
            raise FileNotFoundError(path)
        from urllib.request import pathname2url

        self.db = sqlite3.connect(f"file:{pathname2url(local)}?mode=ro&cache=private", uri=True)
        try:
            (found,) = self.db.execute("PRAGMA application_id").fetchone()
        except sqlite3.DatabaseError as error:
            self.close()
            raise Malformed(f"{path} is not a GeoPackage") from error
        if found != APPLICATION_ID:
            self.close()
            raise Malformed(f"{path} is not a GeoPackage: its application_id is {found:#x}")

    def close(self) -> None:
        self.db.close()

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def layers(self) -> list[dict]:
        rows = self.db.execute(
            """SELECT g.table_name, g.column_name, g.geometry_type_name, g.srs_id, c.min_x, c.min_y, c.max_x, c.max_y, s.organization, s.organization_coordsys_id, s.definition, s.srs_name
            FROM gpkg_geometry_columns g JOIN gpkg_contents c ON c.table_name = g.table_name LEFT JOIN gpkg_spatial_ref_sys s ON s.srs_id = g.srs_id
            WHERE c.data_type = 'features' ORDER BY g.table_name"""
        )
        names = ("layer", "column", "kind", "srs", "minx", "miny", "maxx", "maxy", "organization", "code", "definition", "name")
        return [dict(zip(names, r)) for r in rows]

    def layer(self, name: str) -> dict:
        for x in self.layers():
            if x["layer"] == name:
                return x
        raise ValueError(f"no layer {name}")

    def key(self, layer: str) -> str:
        """The key column with the least rank."""
        ranked = [(r[5], r[1]) for r in self.db.execute(f"PRAGMA table_info({quoted(layer)})") if r[5] > 0]
        if not ranked:
            raise Malformed(f"layer {layer} has no primary key")
        return min(ranked)[1]

    def count(self, layer: str) -> int:
        return self.db.execute(f"SELECT count(*) FROM {quoted(layer)}").fetchone()[0]

    def ranges(self, layer: str, rows: int) -> list[tuple | None]:
        """Key ranges of about ``rows`` rows; one without limits if the key isn't a whole number."""
        key = quoted(self.key(layer))
        low, high = self.db.execute(f"SELECT min({key}), max({key}) FROM {quoted(layer)}").fetchone()
        if not isinstance(low, int) or not isinstance(high, int):
            return [None]
        step = max(1, math.ceil((high - low + 1) / max(1, math.ceil(self.count(layer) / rows))))
        return [(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def rows(self, layer: str, keys: tuple | None = None, extent: tuple | None = None):
        """(key, geometry, declared box, attributes). With an extent the layer's index decides alone; without one bounds are computed."""
        known = self.layer(layer)
        column, key = known["column"], self.key(layer)
        tree = f"rtree_{layer}_{column}"
        indexed = extent is not None and self.db.execute("SELECT EXISTS (SELECT 1 FROM sqlite_master WHERE name = ?)", (tree,)).fetchone()[0]
        sql, args = f"SELECT f.* FROM {quoted(layer)} f", []
        if indexed:
            sql += f" JOIN {quoted(tree)} r ON f.{quoted(key)} = r.id"
        conditions = []
        if keys is not None:
            conditions.append(f"f.{quoted(key)} BETWEEN ? AND ?")
            args += keys
        if indexed:
            conditions.append("r.minx <= ? AND r.maxx >= ? AND r.miny <= ? AND r.maxy >= ?")
            args += [extent[2], extent[0], extent[3], extent[1]]
        if conditions:
            sql += " WHERE " + " AND ".join(conditions)
        cursor = self.db.execute(sql, args)
        names = [d[0] for d in cursor.description]
        if len(set(names)) < len(names):
            raise Malformed(f"a column name of layer {layer} repeats")
        for r in cursor:
            row = dict(zip(names, r))
            blob, geometry, declared = row.pop(column), None, None
            if blob is not None:
                geometry, srs, declared, _ = gpkg_blob(blob)
                if srs != known["srs"]:
                    raise Malformed(f"a geometry of layer {layer} has reference system {srs}, not {known['srs']}")
            if extent is not None and not indexed and not intersects(bounds(geometry), extent):
                continue
            yield row[key], geometry, declared, row


def as_json(row: dict) -> str:
    return json.dumps({k: base64.b64encode(v).decode() if isinstance(v, bytes) else v for k, v in row.items()}, ensure_ascii=False)


def encode(layers: list[dict]) -> bytes:
    """A GeoPackage of layers {name, kind, srs, columns: [(name, type)], rows: [(id, geometry, values)], index: bool}."""
    handle, path = tempfile.mkstemp(suffix=".gpkg")
    os.close(handle)
    db = sqlite3.connect(path)
    db.execute(f"PRAGMA application_id = {APPLICATION_ID}")
    db.executescript("""
      CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);
      CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
      CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);
      INSERT INTO gpkg_spatial_ref_sys VALUES ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]]', NULL);
    """)
    for x in layers:
        name, boxes = x["name"], []
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 2, 2)", (name, x["kind"], x["srs"]))
        columns = "".join(f", {quoted(c)} {t}" for c, t in x["columns"])
        db.execute(f"CREATE TABLE {quoted(name)} (fid INTEGER PRIMARY KEY, geom BLOB{columns})")
        tree = quoted(f"rtree_{name}_geom")
        if x.get("index"):
            db.execute(f"CREATE TABLE {tree} (id INTEGER PRIMARY KEY, minx REAL, maxx REAL, miny REAL, maxy REAL)")
        for id, geometry, values in x["rows"]:
            db.execute(f"INSERT INTO {quoted(name)} VALUES (?, ?{', ?' * len(x['columns'])})", (id, to_gpkg_blob(geometry, x["srs"]), *values))
            if b := bounds(geometry):
                boxes.append(b)
                if x.get("index"):
                    db.execute(f"INSERT INTO {tree} VALUES (?, ?, ?, ?, ?)", (id, b[0], b[2], b[1], b[3]))
        box = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else (None,) * 4
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, NULL, NULL, ?, ?, ?, ?, ?)", (name, name, *box, x["srs"]))
    db.commit()
    db.close()
    with open(path, "rb") as f:
        data = f.read()
    os.unlink(path)
    return data
