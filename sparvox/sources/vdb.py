"""The .vdb format, float grids of the 5-4-3 tree: read by tasks, one file each, into grids and leaves.

Inactive slots that the stream leaves out take the value its codes give; codes 0 and 3 give 0 (documented behaviour)."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.keys import scale_matrix
from .nvdb import FormatError, UnsupportedError, _slot_xyz

MAGIC = 0x56444220  # fixed value
ZIP, ACTIVE_MASK, BLOSC = 1, 2, 4
GRID_TYPE = re.compile(r"^Tree_([A-Za-z0-9]+)_(\d+)_(\d+)_(\d+)$")


class Cursor:
    """Typed little-endian reads that never run past the end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError(f"{n} bytes are due at {self.at}, but there are {len(self.data) - self.at}")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def get(self, fmt: str):
        got = struct.unpack("<" + fmt, self.take(struct.calcsize("<" + fmt)))
        return got[0] if len(got) == 1 else got

    def string(self) -> str:
        return self.take(self.get("I")).decode("utf-8", "replace")

    def seek(self, at: int) -> None:
        if not 0 <= at <= len(self.data):
            raise FormatError(f"position {at} lies outside the file")
        self.at = at

    def mask(self, n: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.take(n // 8), np.uint8), bitorder="little").astype(bool)


READERS = {"bool": "?", "int32": "i", "int64": "Q", "float": "f", "double": "d", "vec3i": "3i", "vec3s": "3f", "vec3d": "3d"}


def metadata(c: Cursor) -> dict[str, tuple[str, object]]:
    """name: (type, value); unknown types stay bytes, and the declared length rules."""
    out = {}
    for _ in range(c.get("I")):
        name, kind, raw = c.string(), c.string(), c.take(c.get("I"))
        if kind == "string":
            value = raw.decode("utf-8", "replace")
        else:
            fmt = READERS.get(kind)
            if fmt and len(raw) < struct.calcsize("<" + fmt):
                raise FormatError(f"metadata {name} is too short for {kind}")
            got = struct.unpack_from("<" + fmt, raw) if fmt else (raw,)
            value = list(got) if len(got) > 1 else got[0]
        out[name] = (kind, value)
    return out


def transform(c: Cursor) -> tuple[str, list[float], list[float]]:
    """(map type, 4 x 4 matrix row by row, voxel size)."""
    kind = c.string()
    if kind in ("UniformScaleTranslateMap", "ScaleTranslateMap"):
        move, scale, voxel, *_ = (c.get("3d") for _ in range(6))
    elif kind in ("UniformScaleMap", "ScaleMap"):
        move = (0.0, 0.0, 0.0)
        scale, voxel, *_ = (c.get("3d") for _ in range(5))
    elif kind == "TranslationMap":
        move, scale, voxel = c.get("3d"), (1.0, 1.0, 1.0), (1.0, 1.0, 1.0)
    else:
        raise UnsupportedError(f"transform map {kind} is not supported")
    return kind, scale_matrix(list(scale), list(move)), list(voxel)


def raw_values(c: Cursor, n: int, half: bool, flags: int) -> np.ndarray:
    kind, size = ("<f2", 2) if half else ("<f4", 4)
    if flags & (BLOSC | ZIP):
        stored = c.get("q")
        if stored <= 0:  # not worth compressing: so many plain bytes follow
            return np.frombuffer(c.take(-stored), kind).astype("<f4")
        raw = c.take(stored)
        if flags & BLOSC:
            raise UnsupportedError("blosc-compressed files are not supported; write them with zip or none")
        try:
            raw = zlib.decompressobj().decompress(raw, n * size)
        except zlib.error as e:
            raise FormatError(f"broken zip values: {e}") from None
        if len(raw) < n * size:
            raise FormatError("zip values are cut short")
        return np.frombuffer(raw, kind, n).astype("<f4")
    return np.frombuffer(c.take(n * size), kind).astype("<f4")


def node_values(c: Cursor, n: int, mask: np.ndarray, version: int, flags: int, half: bool, background: float) -> np.ndarray:
    """A node's values; code says what inactive ones are: 0, 3 zero; 1 minus background; 2, 4 one value; 5 two by a mask; 6 all stored."""
    code = c.get("B") if version >= 222 else 0
    fill = [0.0, 0.0]
    if code == 1:
        fill[0] = -background
    elif code in (2, 4, 5):
        fill[0] = c.get("f")
        fill[1] = c.get("f") if code == 5 else fill[0]
    chosen = c.mask(n) if code in (3, 4, 5) else np.zeros(n, bool)
    due = int(mask.sum()) if flags & ACTIVE_MASK and code != 6 and version >= 222 else n
    raw = raw_values(c, due, half, flags)
    if not flags & ACTIVE_MASK or len(raw) == n:
        return raw
    out = np.where(chosen, np.float32(fill[1]), np.float32(fill[0])).astype("<f4")
    if mask.sum() > len(raw):
        raise FormatError("a node has fewer values than active slots")
    out[mask] = raw[: int(mask.sum())]
    return out


def tree(c: Cursor, version: int, flags: int, half: bool) -> tuple[float, list[tuple]]:
    """Background and leaves (ox, oy, oz, values, mask words): topology first, then the leaves' values."""
    if c.get("I") != 1:
        raise UnsupportedError("trees with several buffers are not supported")
    background, n_tiles, n_children = c.get("f"), *c.get("II")
    for _ in range(n_tiles):
        if c.get("3if?")[4]:
            raise UnsupportedError("active root tiles are not supported")

    def internal(size: int) -> np.ndarray:
        child, active = c.mask(size), c.mask(size)
        stored = int((~child).sum()) if version < 222 else size
        node_values(c, stored, active[:stored] if stored != size else active, version, flags, half, background)
        if (active & ~child).any():
            raise UnsupportedError("active tiles are not supported")
        return np.flatnonzero(child)

    origins = []
    for _ in range(n_children):
        upper = c.get("3i")
        for k in internal(32768):
            lower = [a + b for a, b in zip(upper, _slot_xyz(int(k), 5, 128))]
            for j in internal(4096):
                c.mask(512)
                origins.append(tuple(a + b for a, b in zip(lower, _slot_xyz(int(j), 4, 8))))
    out = []
    for o in origins:
        if version < 222:
            c.get("3i")
            if c.get("B") != 1:
                raise FormatError("leaves with several buffers are not supported")
        mask = c.mask(512)
        out.append((*o, node_values(c, 512, mask, version, flags, half, background), np.packbits(mask, bitorder="little").view("<i8")))
    return background, out


def parse(data: bytes) -> Iterator[tuple[dict, list[tuple]]]:
    """(description, leaves) of every grid of a file."""
    c = Cursor(data)
    if c.get("Q") != MAGIC:
        raise FormatError("bad magic number: not a .vdb file")
    version = c.get("I")
    c.get("II")
    if version < 218:
        raise UnsupportedError(f"file version {version} is too old")
    if not c.get("?"):
        raise UnsupportedError("files without grid offsets are not supported")
    if 220 <= version < 222:
        header = ZIP if c.get("?") else 0
    else:
        header = ZIP if version < 220 else ACTIVE_MASK | (BLOSC if version >= 223 else ZIP)
    c.take(36)
    metadata(c)
    for _ in range(c.get("I")):
        unique, kind = c.string(), c.string()
        half = "_HalfFloat" in kind
        kind = kind.replace("_HalfFloat", "")
        name = unique.split("\x1e")[0]
        if version >= 216 and c.string():
            raise UnsupportedError(f"grid {name} shares another grid's tree")
        start, _, end = c.get("QQQ")
        c.seek(start)
        flags = c.get("I") if version >= 222 else header
        meta = metadata(c)
        half = half or meta.get("is_saved_as_half_float", ("", False))[1] is True
        m = GRID_TYPE.match(kind)
        if not m or m.groups() != ("float", "5", "4", "3"):
            raise UnsupportedError(f"grid {name}: {kind} is not supported, only Tree_float_5_4_3")
        map_type, matrix, voxel = transform(c)
        background, leaves = tree(c, version, flags, half)
        box = [meta.get(k, (None, None))[1] for k in ("file_bbox_min", "file_bbox_max")]
        count = sum(int(np.unpackbits(x[4].view(np.uint8)).sum()) for x in leaves)
        yield {"name": name, "grid_type": kind, "map_type": map_type, "matrix": matrix, "voxel_size": voxel, "background": background, "voxel_count": count, "leaf_count": len(leaves), "index_min": box[0], "index_max": box[1], "metadata": {k: str(v[1]) for k, v in meta.items()}}, leaves
        c.seek(end)


GRIDS = "path string, grid_index int, name string, grid_type string, map_type string, matrix array<double>, voxel_size array<double>, background double, voxel_count long, leaf_count long, index_min array<int>, index_max array<int>, metadata map<string,string>, error string"
LEAVES = "path string, grid_index int, ox int, oy int, oz int, values array<float>, mask array<bigint>, active_count long"


def read(spark: SparkSession, path: str, table: str = "grids", permissive: bool = False) -> DataFrame:
    """Tables of .vdb files at a path of any store that Spark reads: grids or leaves."""
    return tables(spark.read.format("binaryFile").load(path), table, permissive)


def tables(files: DataFrame, table: str = "grids", permissive: bool = False) -> DataFrame:
    """The same of files at hand as rows (path, content)."""
    schema = {"grids": GRIDS, "leaves": LEAVES}[table]
    names = re.findall(r"(?:^|, )(\w+) ", schema)

    def rows(p, data):
        try:
            for i, (meta, leaves) in enumerate(parse(data)):
                if table == "grids":
                    yield {"path": p, "grid_index": i, **meta}
                else:
                    for ox, oy, oz, values, mask in leaves:
                        yield {"path": p, "grid_index": i, "ox": ox, "oy": oy, "oz": oz, "values": values.tolist(), "mask": mask.tolist(), "active_count": int(np.unpackbits(mask.view(np.uint8)).sum())}
        except ValueError as e:
            if not permissive:
                raise
            if table == "grids":
                yield {"path": p, "error": str(e)}

    def run(frames):
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                held = [[r.get(n) for n in names] for r in rows(p, bytes(data))]
                for i in range(0, len(held), 512):
                    yield pd.DataFrame(held[i : i + 512], columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, schema)
