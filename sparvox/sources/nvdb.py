"""The .nvdb format: grid images and files of them, read and written by tasks; one file is one task's work.

Layout constants are those of ABI 32.9. Reading gives rows of grids, leaves and tiles; writing groups leaves by grid."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.keys import GRID_CLASSES, GRID_TYPES


class FormatError(ValueError):
    """The bytes are malformed."""


class UnsupportedError(ValueError):
    """The bytes are in order, but out of scope."""


# Fixed values of the format: magic numbers, sizes and offsets.
MAGIC_GRID, MAGIC_FILE, MAGIC_OLD = b"NanoVDB1", b"NanoVDB2", b"NanoVDB0"
VERSION = 32 << 21 | 9 << 10 | 1
FLAGS, NO_CHECKSUM = 0x3E, (1 << 64) - 1
GRID, TREE, ROOT, TILE, UPPER, LOWER = 672, 64, 64, 32, 270400, 33856
LEAF_BYTES = {1: 2144, 14: 608}
FILE_HEADER, FILE_META = "<8sIHH", "<QQQQII6d6i3dI4I3IHHI"
SAFE = (1 << 53) - 1
FLOAT, FP8, FPN = 1, 14, 16
STAT = 2


def _require(ok: bool, what: str, kind=FormatError) -> None:
    if not ok:
        raise kind(what)


def check_type(grid_type: int) -> None:
    name = GRID_TYPES[grid_type] if grid_type < len(GRID_TYPES) else f"Unknown({grid_type})"
    _require(grid_type in (FLOAT, FP8, FPN), f"grids of type {name} are not supported", UnsupportedError)


def inflate(raw: bytes, size: int) -> bytes:
    """The zlib stream behind an 8-byte length, never more than a byte beyond the size that is due."""
    _require(len(raw) >= 8, "compressed grid is cut short")
    n = struct.unpack_from("<Q", raw)[0]
    _require(n <= len(raw) - 8, "compressed grid is cut short")
    try:
        out = zlib.decompressobj().decompress(raw[8 : 8 + n], size + 1)
    except zlib.error as e:
        raise FormatError(f"compressed grid is broken: {e}") from None
    _require(len(out) == size, "compressed grid has another size than its header says")
    return out


def images(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(metadata, image) of every grid of a file, be it of segments or raw grids."""
    _require(len(data) >= 16, "too short for any grid")
    if data[:8] in (MAGIC_FILE, MAGIC_OLD):
        at = 0
        while at < len(data):
            _require(len(data) - at >= 16 and data[at : at + 8] in (MAGIC_FILE, MAGIC_OLD), "segment header is cut short or broken")
            _, version, count, codec = struct.unpack_from(FILE_HEADER, data, at)
            _require(version >> 21 == 32, f"version {version >> 21} is not supported", UnsupportedError)
            _require(codec in (0, 1), "codec BLOSC is not supported; write the file with ZIP or none" if codec == 2 else f"codec {codec} is not known", UnsupportedError)
            at += 16
            heads = []
            for _ in range(count):
                _require(len(data) - at >= 176, "grid header is cut short")
                m = struct.unpack_from(FILE_META, data, at)
                at += 176
                _require(max(m[0], m[1], m[3]) <= SAFE, "a size is beyond 2^53")
                name = data[at : at + m[21]]
                _require(len(name) == m[21], "grid name is cut short")
                at += m[21]
                raw = data[at : at + m[1]]
                _require(len(raw) == m[1], "grid is cut short")
                at += m[1]
                heads.append((m, name, raw))
            for m, name, raw in heads:
                check_type(m[4])
                image = raw if codec == 0 else inflate(raw, m[0])
                _require(len(image) == m[0] and struct.unpack_from("<Q", image, 32)[0] == m[0], "grid size differs from its header's")
                yield {"name": name.split(b"\0")[0].decode(), "grid_type": GRID_TYPES[m[4]], "grid_class": GRID_CLASSES[m[5]], "world_min": list(m[6:9]), "world_max": list(m[9:12]), "index_min": list(m[12:15]), "index_max": list(m[15:18]), "voxel_size": list(m[18:21]), "voxel_count": m[3], "grid_bytes": m[0]}, image
        return
    _require(data[:8] == MAGIC_GRID, "not an .nvdb file")
    at, count = 0, struct.unpack_from("<I", data, 28)[0] if len(data) >= GRID else 1
    for _ in range(max(1, count)):
        _require(len(data) - at >= GRID + TREE + ROOT and data[at : at + 8] == MAGIC_GRID, "grid is cut short")
        size = struct.unpack_from("<Q", data, at + 32)[0]
        _require(size <= SAFE and at + size <= len(data), "grid is cut short")
        image = data[at : at + size]
        yield describe(image), image
        at += size


def describe(image: bytes) -> dict:
    version = struct.unpack_from("<I", image, 16)[0]
    _require(version >> 21 == 32, f"version {version >> 21} is not supported", UnsupportedError)
    grid_class, grid_type = struct.unpack_from("<II", image, 632)
    check_type(grid_type)
    root = GRID + struct.unpack_from("<Q", image, GRID + 24)[0]
    box = struct.unpack_from("<6i", image, root)
    world = struct.unpack_from("<6d", image, 560)
    return {"name": image[40:296].split(b"\0")[0].decode(), "grid_type": GRID_TYPES[grid_type], "grid_class": GRID_CLASSES[grid_class], "world_min": list(world[:3]), "world_max": list(world[3:]), "index_min": list(box[:3]), "index_max": list(box[3:]), "voxel_size": list(struct.unpack_from("<3d", image, 608)), "voxel_count": struct.unpack_from("<Q", image, GRID + 56)[0], "grid_bytes": len(image)}


def _bits(image: bytes, at: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(image, np.uint8, n // 8, at), bitorder="little").astype(bool)


def _slot_xyz(n: int, bits: int, step: int) -> tuple[int, int, int]:
    m = (1 << bits) - 1
    return tuple((n >> s & m) * step for s in (2 * bits, bits, 0))


def decode_leaf(image: bytes, at: int, grid_type: int) -> np.ndarray:
    if grid_type == FLOAT:
        return np.frombuffer(image, "<f4", 512, at + 96).astype(float)
    low, quantum = struct.unpack_from("<ff", image, at + 80)
    bits = 8 if grid_type == FP8 else 1 << (image[at + 15] >> 5)
    raw = np.frombuffer(image, np.uint8, 64 * bits, at + 96)
    if bits >= 8:
        codes = raw.view(f"<u{bits // 8}").astype(float)
    else:
        codes = (np.unpackbits(raw, bitorder="little").reshape(512, bits) * (1 << np.arange(bits))).sum(1).astype(float)
    return codes * float(quantum) + float(low)


def walk(image: bytes) -> tuple[float, list[tuple], list[tuple]]:
    """Background, leaves (origin, values, mask words) and tiles (level, origin, value, active) of a grid image."""
    grid_type = struct.unpack_from("<I", image, 636)[0]
    root = GRID + struct.unpack_from("<Q", image, GRID + 24)[0]
    n, background = struct.unpack_from("<If", image, root + 24)
    leaves, tiles = [], []
    for i in range(n):
        key, child, state, value = struct.unpack_from("<QqIf", image, root + ROOT + TILE * i)
        part = [(key >> s & 0xFFFFF) << 12 for s in (42, 21, 0)]
        o = tuple(p - (1 << 32) if p >= 1 << 31 else p for p in part)
        if not child:
            tiles.append((3, *o, value, bool(state)))
            continue
        up = root + child
        for level, base, origin, slots, step, bits in _children(image, up, o, tiles, background):
            for k in np.flatnonzero(slots):
                lo = base + struct.unpack_from("<q", image, base + 8256 + 8 * int(k))[0]
                lower = tuple(a + b for a, b in zip(origin, _slot_xyz(int(k), 5, 128)))
                value_mask, child_mask = _bits(image, lo + 32, 4096), _bits(image, lo + 544, 4096)
                table = np.frombuffer(image, "<f4", 8192, lo + 1088)[::2]
                tiles += [(1, *(a + b for a, b in zip(lower, _slot_xyz(int(j), 4, 8))), float(table[j]), bool(value_mask[j])) for j in _told(value_mask, child_mask, table, background)]
                for j in np.flatnonzero(child_mask):
                    at = lo + struct.unpack_from("<q", image, lo + 1088 + 8 * int(j))[0]
                    leaves.append((*(a + b for a, b in zip(lower, _slot_xyz(int(j), 4, 8))), decode_leaf(image, at, grid_type), np.frombuffer(image, "<i8", 8, at + 16)))
    return background, leaves, tiles


def _told(active, child, table, background) -> np.ndarray:
    """The tiles of a node that say more than the background does, and its first inactive one, which the background near data is read off."""
    told = ~child & (active | (table != np.float32(background)))
    first = np.flatnonzero(~child & ~active)[:1]
    told[first] = True
    return np.flatnonzero(told)


def _children(image, up, o, tiles, background):
    value_mask, child_mask = _bits(image, up + 32, 32768), _bits(image, up + 4128, 32768)
    table = np.frombuffer(image, "<f4", 65536, up + 8256)[::2]
    tiles += [(2, *(a + b for a, b in zip(o, _slot_xyz(int(k), 5, 128))), float(table[k]), bool(value_mask[k])) for k in _told(value_mask, child_mask, table, background)]
    yield 2, up, o, child_mask, 128, 5


# Writing.


def _stats(values: np.ndarray, mask: np.ndarray) -> tuple:
    v = values[mask].astype(float)
    if not len(v):
        return 0, 0.0, 0.0, 0.0, 0.0
    return len(v), v.sum(), (v * v).sum(), v.min(), v.max()


def _moments(s) -> tuple[float, float, float, float]:
    n, total, squares, low, high = s
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    mean = total / n
    return low, high, mean, float(np.sqrt(max(0.0, squares / n - mean * mean)))


def _merge(a, b):
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4])) if a[0] and b[0] else (a if a[0] else b)


def encode_leaf(values: np.ndarray, codec: str, tolerance: float) -> tuple[int, float, float, np.ndarray]:
    """(bits, minimum, quantum, codes) in the arithmetic of the format: 32-bit floats, but 16-bit codes in double."""
    f = np.float32
    v = values.astype(f)
    low, high = v.min(), v.max()
    span = f(high - low)

    def codes(bits):
        top = (1 << bits) - 1
        if bits == 16:
            return np.clip(np.floor((top / float(span) if span > 0 else 0.0) * (v.astype(float) - float(low)) + 0.5), 0, top).astype(int)
        scale = f(top / span) if span > 0 else f(0)
        return np.clip(np.floor((scale * (v - low)).astype(f) + f(0.5)), 0, top).astype(int)

    if codec == "fp8":
        return 8, float(low), float(f(span / f(255))), codes(8)
    if low == high:
        return 1, float(low), 0.0, codes(1)
    for bits in (1, 2, 4, 8):
        q = f(span / f((1 << bits) - 1))
        back = ((codes(bits).astype(f) * q).astype(f) + low).astype(f)
        if (np.abs((v - back).astype(f)) <= f(tolerance)).all():
            return bits, float(low), float(q), codes(bits)
    return 16, float(low), float(f(span / f(65535))), codes(16)


def pack_codes(codes: np.ndarray, bits: int) -> bytes:
    if bits >= 8:
        return codes.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((codes[:, None] >> np.arange(bits) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def grid_image(leaves: list[tuple], name: str = "", background: float = 0.0, voxel_size: float = 1.0, shift=(0.0, 0.0, 0.0), codec: str = "float", tolerance: float = 0.01, grid_class: int = 2) -> bytes:
    """A grid image of leaves (ox, oy, oz, values, mask words). shift: the world position of index 0."""
    _require(len(name.encode()) < 256, "a grid's name must be shorter than 256 bytes")
    grid_type = {"float": FLOAT, "fp8": FP8, "fpn": FPN}[codec]
    key = lambda o: tuple((c >> 12) << 12 for c in o)
    slot = lambda o, mask, down, bits: sum(((c & mask) >> down) << (bits * (2 - i)) for i, c in enumerate(o))
    rows = sorted(((key(r[:3]), slot(r[:3], 4095, 7, 5), slot(r[:3], 127, 3, 4), tuple(r[:3]), np.asarray(r[3], np.float32), np.asarray(r[4], "<i8")) for r in leaves), key=lambda r: r[:3])
    uppers = sorted({r[0] for r in rows})
    lowers = sorted({r[:2] for r in rows})
    coded = [encode_leaf(r[4], codec, tolerance) if codec != "float" else None for r in rows]
    sizes = [LEAF_BYTES[FLOAT] if c is None else 96 + 64 * c[0] for c in coded]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    root = GRID + TREE
    up0 = root + ROOT + TILE * len(uppers)
    low0 = up0 + UPPER * len(uppers)
    leaf0 = low0 + LOWER * len(lowers)
    out = bytearray(leaf0 + int(starts[-1]))
    empty = (0, 0.0, 0.0, 0.0, 0.0)
    none = (np.full(3, 1 << 31), np.full(3, -(1 << 31)))
    node = {}

    def roll(k, stats, low, high):
        s, a, b = node.get(k, (empty, *none))
        node[k] = (_merge(s, stats), np.minimum(a, low), np.maximum(b, high))

    for i, (r, c) in enumerate(zip(rows, coded)):
        at = leaf0 + int(starts[i])
        mask = np.unpackbits(r[5].view(np.uint8), bitorder="little").astype(bool)
        n = np.flatnonzero(mask)
        xyz = np.array(r[3]) + np.stack([n >> 6 & 7, n >> 3 & 7, n & 7], 1) if len(n) else np.array([r[3]])
        low, high = xyz.min(0), xyz.max(0)
        stats = _stats(r[4], mask)
        if len(n):
            for k in (("l", r[:2]), ("u", r[0]), ("r",)):
                roll(k, stats, low, high)
        d = np.clip(high - low, 0, 255)
        flags = STAT | ((c[0].bit_length() - 1) << 5 if codec == "fpn" else 0)
        struct.pack_into("<3iI", out, at, *map(int, low), int(d[0]) | int(d[1]) << 8 | int(d[2]) << 16 | flags << 24)
        out[at + 16 : at + 80] = r[5].tobytes()
        m = _moments(stats)
        if c is None:
            struct.pack_into("<4f", out, at + 80, *m)
            out[at + 96 : at + 2144] = r[4].astype("<f4").tobytes()
        else:
            bits, lo, q, codes = c
            inv = 1 / q if q > 0 else 0.0
            u16 = [int(np.clip(np.floor(x * inv + 0.5), 0, 65535)) if stats[0] else 0 for x in (m[0] - lo, m[1] - lo, m[2] - lo, m[3])]
            struct.pack_into("<ff4H", out, at + 80, lo, q, *u16)
            out[at + 96 : at + 96 + 64 * bits] = pack_codes(codes, bits)

    def internal(at, k, child_mask, table, count, stat_at, children):
        s, low, high = node.get(k, (empty, np.zeros(3, int), np.zeros(3, int)))
        struct.pack_into("<6iQ", out, at, *map(int, low), *map(int, high), STAT)
        mask = np.zeros(count, np.uint8)
        cells = np.zeros(count, "<i8")
        if background:
            cells.view("<f4")[::2] = background
        for j, to in children:
            mask[j], cells[j] = 1, to - at
        out[at + child_mask : at + child_mask + count // 8] = np.packbits(mask, bitorder="little").tobytes()
        struct.pack_into("<4f", out, at + stat_at, *_moments(s))
        out[at + table : at + table + 8 * count] = cells.tobytes()

    low_at = {k: low0 + LOWER * i for i, k in enumerate(lowers)}
    kids = {k: [] for k in lowers}
    for i, r in enumerate(rows):
        kids[r[:2]].append((r[2], leaf0 + int(starts[i])))
    for k in lowers:
        internal(low_at[k], ("l", k), 544, 1088, 4096, 1056, kids[k])
    s, low, high = node.get(("r",), (empty, np.zeros(3, int), np.full(3, -1)))
    struct.pack_into("<6iIf4f", out, root, *map(int, low), *map(int, high), len(uppers), background, *_moments(s))
    for i, u in enumerate(uppers):
        at = up0 + UPPER * i
        internal(at, ("u", u), 4128, 8256, 32768, 8224, [(k[1], low_at[k]) for k in lowers if k[0] == u])
        x, y, z = ((c & 0xFFFFFFFF) >> 12 for c in u)
        struct.pack_into("<QqIf", out, root + ROOT + TILE * i, x << 42 | y << 21 | z, at - root, 0, 0.0)
    struct.pack_into("<8sQIIIIQ", out, 0, MAGIC_GRID, NO_CHECKSUM, VERSION, FLAGS, 0, 1, len(out))
    out[40 : 40 + len(name.encode())] = name.encode()
    m, inv = np.diag([voxel_size] * 3).ravel(), np.diag([1 / voxel_size] * 3).ravel()
    struct.pack_into("<9f9f3ff9d9d3dd", out, 296, *m, *inv, *shift, 1.0, *m, *inv, *shift, 1.0)
    struct.pack_into("<6d3dIIqI", out, 560, *[a * voxel_size + t for a, t in zip(low, shift)], *[(a + 1) * voxel_size + t for a, t in zip(high, shift)], *[voxel_size] * 3, grid_class, grid_type, len(out), 0)
    struct.pack_into("<4Q3I3IQ", out, GRID, leaf0 - GRID, low0 - GRID, up0 - GRID, root - GRID, len(rows), len(lowers), len(uppers), 0, 0, 0, s[0])
    return bytes(out)


def file_bytes(grids: list[bytes], codec: int = 0) -> bytes:
    """A file of one segment."""
    _require(0 < len(grids) <= 65535, "a file holds 1 to 65535 grids")
    out = [struct.pack(FILE_HEADER, MAGIC_FILE, VERSION, len(grids), codec)]
    for g in grids:
        d = describe(g)
        _require(struct.unpack_from("<Q", g, 32)[0] == len(g), "grid size differs from its image's")
        nodes = struct.unpack_from("<3I", g, GRID + 32)
        name = d["name"].encode() + b"\0"
        raw = g if codec == 0 else (lambda z: struct.pack("<Q", len(z)) + z)(zlib.compress(g))
        out += [struct.pack(FILE_META, len(g), len(raw), 0, d["voxel_count"], GRID_TYPES.index(d["grid_type"]), GRID_CLASSES.index(d["grid_class"]), *d["world_min"], *d["world_max"], *d["index_min"], *d["index_max"], *d["voxel_size"], len(name), *nodes, 1, 0, 0, 0, codec, 0, VERSION), name, raw]
    return b"".join(out)


# Spark.

META = "name string, grid_type string, grid_class string, world_min array<double>, world_max array<double>, index_min array<int>, index_max array<int>, voxel_size array<double>, voxel_count long, grid_bytes long"
GRIDS = f"path string, grid_index int, {META}, background double, error string"
LEAVES = "path string, grid_index int, ox int, oy int, oz int, values array<double>, mask array<bigint>, active_count long"
TILES = "path string, grid_index int, level int, ox int, oy int, oz int, value double, active boolean"


def _rows(path: str, data: bytes, table: str, permissive: bool) -> Iterator[dict]:
    try:
        for i, (meta, image) in enumerate(images(data)):
            at = {"path": path, "grid_index": i}
            if table == "grids":  # the headers tell all; no node is visited
                root = GRID + struct.unpack_from("<Q", image, GRID + 24)[0]
                yield {**at, **meta, "background": struct.unpack_from("<f", image, root + 28)[0], "error": None}
                continue
            background, leaves, tiles = walk(image)
            if table == "leaves":
                for ox, oy, oz, values, mask in leaves:
                    yield {**at, "ox": ox, "oy": oy, "oz": oz, "values": values.tolist(), "mask": mask.tolist(), "active_count": int(np.unpackbits(mask.view(np.uint8)).sum())}
            else:
                for level, ox, oy, oz, value, active in tiles:
                    yield {**at, "level": level, "ox": ox, "oy": oy, "oz": oz, "value": value, "active": active}
    except ValueError as e:
        if not permissive:
            raise
        if table == "grids":
            yield {"path": path, "error": str(e)}


def read(spark: SparkSession, path: str, table: str = "grids", permissive: bool = False) -> DataFrame:
    """Tables of .nvdb files at a path of any store that Spark reads: grids, leaves or tiles. permissive: a broken file is a grids row with an error."""
    return tables(spark.read.format("binaryFile").load(path), table, permissive)


def tables(files: DataFrame, table: str = "grids", permissive: bool = False) -> DataFrame:
    """The same of files at hand as rows (path, content)."""
    schema = {"grids": GRIDS, "leaves": LEAVES, "tiles": TILES}[table]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                held = []
                for r in _rows(p, bytes(data), table, permissive):
                    held.append([r.get(n) for n in names])
                    if len(held) == 512:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, schema)


class NvdbSource(DataSource):
    """spark.read.format("nvdb").option("table", ...).load(path): for paths that the executors open themselves; read() takes any path."""

    @classmethod
    def name(cls) -> str:
        return "nvdb"

    def schema(self) -> str:
        return {"grids": GRIDS, "leaves": LEAVES, "tiles": TILES}[self.options.get("table", "grids")]

    def reader(self, schema) -> DataSourceReader:
        return _NvdbReader(self.options, [f.name for f in schema.fields])


class _File(InputPartition):
    pass


class _NvdbReader(DataSourceReader):
    def __init__(self, options, names):
        self.path, self.table, self.permissive, self.names = options["path"], options.get("table", "grids"), options.get("permissive") == "true", names

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "*.nvdb")) if os.path.isdir(self.path) else glob.glob(self.path))
        return [_File(p) for p in found]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            for r in _rows(partition.value, f.read(), self.table, self.permissive):
                yield tuple(r.get(n) for n in self.names)


def to_images(leaf: DataFrame, key: str = "grid_id", **how) -> DataFrame:
    """(key, image): leaves of each grid as a grid image. Only here do all leaves of a grid meet in one task: a file is one value."""

    def run(k, frame):
        rows = list(zip(frame["ox"].tolist(), frame["oy"].tolist(), frame["oz"].tolist(), frame["values"], frame["mask"], strict=True))
        return pd.DataFrame({key: [k[0]], "image": [grid_image(rows, name=str(k[0]), **how)]})

    kind = dict(leaf.dtypes)[key]
    return leaf.select(key, "ox", "oy", "oz", "values", "mask").groupBy(key).applyInPandas(run, f"{key} {kind}, image binary")


def pack_files(grids: DataFrame, file: str, codec: int = 0, key: str = "grid_id") -> DataFrame:
    """(path, content): the images (key, image) of each value of column `file` as one file of one segment, in the order of key. Write the
    rows with any sink that takes bytes; tables() reads them back. The grids of a file meet in one task: a file is one value."""

    def run(k, frame):
        return pd.DataFrame({"path": [f"{k[0]}.nvdb"], "content": [file_bytes([bytes(x) for x in frame.sort_values(key)["image"]], codec)]})

    return grids.select(file, key, "image").groupBy(file).applyInPandas(run, "path string, content binary")


def from_images(grids: DataFrame, key: str = "grid_id") -> DataFrame:
    """(key, image) back to the leaves of each grid."""
    kind = dict(grids.dtypes)[key]
    names = ["ox", "oy", "oz", "values", "mask", "active_count"]
    kinds = dict(c.split(maxsplit=1) for c in LEAVES.split(", "))

    def run(frames):
        for f in frames:
            for k, image in zip(f[key], f["image"], strict=True):
                rows = list(_rows("", bytes(image), "leaves", False))
                yield pd.DataFrame([[k, *[r[n] for n in names]] for r in rows], columns=[key, *names])

    return grids.select(key, "image").mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} {kinds[n]}" for n in names))


def write(grids: DataFrame, folder: str, key: str = "grid_id", codec: int = 0) -> None:
    """One file a row of (key, image) in a folder that the executors share; a file appears whole or not at all."""
    import os

    def run(rows):
        import uuid

        for r in rows:
            part = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(file_bytes([bytes(r["image"])], codec))
            os.replace(part, os.path.join(folder, f"{r[key]}.nvdb"))

    os.makedirs(folder, exist_ok=True)
    grids.select(key, "image").foreachPartition(run)


def load(files: DataFrame, table: str = "grids", permissive: bool = False) -> DataFrame:
    """Grids (path, grid_index, name, grid_type, background, voxel_count) or leaves of files (path, content), each by its own format.
    Files of no known format give no rows, or with permissive a grids row with an error."""
    from . import vdb

    told = files.withColumn("__format", detect(F.col("path")))
    names = {"grids": ["path", "grid_index", "name", "grid_type", "background", "voxel_count", "error"], "leaves": ["path", "grid_index", "ox", "oy", "oz", "values", "mask", "active_count"]}[table]
    rows = tables(told.where("__format = 'nvdb'"), table, permissive).select(*names)
    other = vdb.tables(told.where("__format = 'vdb'"), table, permissive).select(*names)
    rows = rows.unionByName(other.withColumn("values", F.col("values").cast("array<double>")) if table == "leaves" else other)
    if table == "grids" and permissive:
        unknown = told.where("__format = 'unknown'").select(*[F.lit(None).cast(rows.schema[n].dataType).alias(n) if n not in ("path", "error") else F.col("path") if n == "path" else F.lit("no known format").alias("error") for n in names])
        rows = rows.unionByName(unknown)
    return rows


def detect(path) -> object:
    """Column: the format by the name's end, else by magic number (columns path, content)."""
    magic = F.substring("content", 1, 7).cast("string") == "NanoVDB"
    return F.when(path.endswith(".vdb"), "vdb").when(path.endswith(".nvdb") | magic, "nvdb").otherwise("unknown")
