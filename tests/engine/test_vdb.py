"""The .vdb reader against bytes that this file writes itself."""

import struct
import zlib

import numpy as np
import pytest

from sparvox.sources import vdb


def text(s):
    return struct.pack("<I", len(s)) + s.encode()


def mask(on, n):
    m = np.zeros(n, np.uint8)
    m[list(on)] = 1
    return np.packbits(m, bitorder="little").tobytes()


def values(v, active, flags, code, half, fill=()):
    out = struct.pack("<B", code) + b"".join(struct.pack("<f", x) for x in fill)
    if code in (3, 4, 5):
        out += mask([i for i in range(len(v)) if not active[i] and len(fill) > 1 and v[i] == np.float32(fill[1])], len(v))
    raw = v[active] if flags & 2 and code != 6 else v
    raw = raw.astype("<f2" if half else "<f4").tobytes()
    if flags & 5:
        z = zlib.compress(raw)
        return out + (struct.pack("<q", len(z)) + z if len(z) < len(raw) else struct.pack("<q", -len(raw)) + raw)
    return out + raw


def make(leaves, flags=3, half=False, code=6, background=0.25, fill=(), map_type="UniformScaleMap", kind="Tree_float_5_4_3", tile=False):
    """leaves: {slot in the lower node: (values, active)} of one lower node at slot 0 of the upper node at the origin."""
    head = struct.pack("<QIII?", vdb.MAGIC, 224, 9, 0, True) + b"0" * 36 + struct.pack("<I", 1) + text("creator") + text("string") + text("test") + struct.pack("<I", 1)
    name = text("density\x1e0") + text(kind + ("_HalfFloat" if half else "")) + text("")
    meta = struct.pack("<I", 3) + text("class") + text("string") + text("fog") + text("file_bbox_min") + text("vec3i") + struct.pack("<I3i", 12, 1, 2, 3) + text("odd") + text("blob") + struct.pack("<I", 2) + b"ab"
    d3 = struct.pack("<3d", 0.5, 0.5, 0.5)
    maps = {"UniformScaleMap": d3 * 5, "UniformScaleTranslateMap": struct.pack("<3d", 1, 2, 3) + d3 * 5, "TranslationMap": struct.pack("<3d", 1, 2, 3), "AffineMap": b""}
    body = struct.pack("<I", flags) + meta + text(map_type) + maps[map_type] + struct.pack("<IfII", 1, background, 0, 1) + struct.pack("<3i", -4096, 0, 0)
    none = lambda n: np.zeros(n, bool)
    on = none(32768)
    on[5] = tile
    body += mask([0], 32768) + mask(np.flatnonzero(on), 32768) + values(np.zeros(32768, "<f4"), on, flags & ~4, 0, half)
    body += mask(leaves, 4096) + mask([], 4096) + values(np.zeros(4096, "<f4"), none(4096), flags & ~4, 0, half)
    for v, a in leaves.values():
        body += mask(np.flatnonzero(a), 512)
    for v, a in leaves.values():
        body += mask(np.flatnonzero(a), 512) + values(v, a, flags, code, half, fill)
    start = len(head) + len(name) + 24
    return head + name + struct.pack("<3Q", start, start, start + len(body)) + body


def sample(inactive):
    rng = np.random.default_rng(0)
    a = rng.random(512) < 0.4
    v = np.where(a, rng.random(512).astype(np.float16), np.resize(np.float16(inactive), 512)).astype("<f4")
    return {0: (v, a), 257: (v[::-1].copy(), a[::-1].copy())}


@pytest.mark.parametrize("flags", [0, 1, 2, 3])
@pytest.mark.parametrize(("code", "inactive", "fill"), [(0, [0.0], ()), (1, [-0.25], ()), (2, [0.5], (0.5,)), (5, [0.5, 0.75], (0.5, 0.75)), (6, [0.125, 3.0], ())])
@pytest.mark.parametrize("half", [False, True])
def test_read_back(flags, code, inactive, fill, half):
    leaves = sample(inactive)
    (meta, got), = vdb.parse(make(leaves, flags, half, code, fill=fill))
    assert meta["name"] == "density" and meta["background"] == 0.25 and meta["index_min"] == [1, 2, 3] and meta["index_max"] is None
    assert meta["voxel_count"] == sum(a.sum() for _, a in leaves.values())
    assert [x[:3] for x in got] == [(-4096, 0, 0), (-4096 + 8, 0, 8)]
    for (v, a), x in zip(leaves.values(), got):
        assert np.array_equal(x[3], v) and np.array_equal(np.unpackbits(x[4].view(np.uint8), bitorder="little").astype(bool), a)


def test_tables(spark, tmp_path):
    (tmp_path / "a.vdb").write_bytes(make(sample([0.0]), map_type="UniformScaleTranslateMap"))
    (tmp_path / "b.vdb").write_bytes(b"nothing of the kind")
    g = {r["path"][-5:]: r for r in vdb.read(spark, str(tmp_path), permissive=True).collect()}
    assert g["a.vdb"]["matrix"][12:15] == [1.0, 2.0, 3.0] and g["a.vdb"]["voxel_size"] == [0.5] * 3 and g["b.vdb"]["error"]
    assert vdb.read(spark, f"{tmp_path}/a.vdb", "leaves").count() == 2


@pytest.mark.parametrize("how", [{"map_type": "AffineMap"}, {"kind": "Tree_vec3s_5_4_3"}, {"kind": "Tree_float_4_4_3"}, {"flags": 6}, {"tile": True}])
def test_unsupported(how):
    with pytest.raises(vdb.UnsupportedError):
        list(vdb.parse(make({0: (np.ones(512, "<f4"), np.ones(512, bool))}, **how)))


def test_malformed():
    data = make(sample([0.0]))
    for bad in (b"", data[:7], b"x" * 100, data[:200], data[:-50]):
        with pytest.raises(vdb.FormatError):
            list(vdb.parse(bad))
