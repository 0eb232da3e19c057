"""Grids against numpy models and known figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparvox.functions import keys as K
from sparvox.functions import masks as M
from sparvox.operators import codec as C
from sparvox.operators import grids as G
from sparvox.operators import lookup as L
from sparvox.operators import rays as R
from sparvox.operators import sequences as S
from sparvox.sources import nvdb


def dense(spark, values, origin=(0, 0, 0), **how):
    rows = [(values.ravel().astype(float).tolist(), list(values.shape), list(origin))]
    return G.from_dense(spark.createDataFrame(rows, "values array<double>, dims array<int>, origin array<int>"), **how)


CASES = {
    "single leaf": (np.fromfunction(lambda x, y, z: np.where((x + y + z) % 5 == 0, 0, 0.1 + 0.01 * (64 * x + 8 * y + z)), (8, 8, 8)), (0, 0, 0), 0.0),
    "crossing": (np.fromfunction(lambda x, y, z: np.maximum(1 - np.sqrt((x - 16) ** 2 + (y - 16) ** 2 + (z - 16) ** 2) / 14, 0), (33, 33, 33)), (-4, -4, -4), 0.0),
    "random": (np.where(np.random.default_rng(1).random((20, 20, 20)) < 0.3, 0, 0.7), (-50, 4090, -4100), 0.0),
    "background": (np.pad(np.fromfunction(lambda x, y, z: 0.5 + 0.01 * (x + y + z), (8, 8, 8)), 8, constant_values=3.0), (0, 0, 0), 3.0),
}


@pytest.mark.parametrize("name", CASES)
def test_dense_round_trip(spark, name):
    values, origin, background = CASES[name]
    leaf = G.leaves(dense(spark, values, origin, background=background), background)
    got = {(r["x"], r["y"], r["z"]): (r["value"], r["active"]) for r in G.leaf_voxels(leaf).collect()}
    for at, v in np.ndenumerate(values):
        p = tuple(a + o for a, o in zip(at, origin))
        assert got.get(p, (np.float32(background), False)) == (np.float32(v), v != background)
    inside = {tuple(a + o for a, o in zip(at, origin)) for at in np.ndindex(values.shape)}
    assert all(v == (np.float32(background), False) for p, v in got.items() if p not in inside)


@pytest.mark.parametrize("codec", ["float", "fp8", "fpn"])
def test_file_round_trip(spark, tmp_path, codec):
    values, origin, background = CASES["random"]
    leaf = G.leaves(dense(spark, values, origin, background=background), background).withColumn("grid_id", F.lit("one"))
    both = leaf.unionByName(G.leaves(dense(spark, CASES["crossing"][0], (-4, -4, -4))).withColumn("grid_id", F.lit("two")))
    nvdb.write(nvdb.to_images(both, codec=codec), str(tmp_path / "out"), codec=1)
    for read in (lambda t: nvdb.read(spark, str(tmp_path / "out"), t),):
        grids = {r["name"]: r for r in read("grids").collect()}
        assert grids["one"]["voxel_count"] == int((values != 0).sum()) and grids["two"]["grid_class"] == "FogVolume"
        assert grids["one"]["index_min"] == [-50, 4090, -4100]
        back = {(r["ox"], r["oy"], r["oz"]): r for r in read("leaves").where(F.col("path").contains("one")).collect()}
        for r in leaf.collect():
            b = back.pop((r["ox"], r["oy"], r["oz"]))
            assert b["mask"] == r["mask"] and np.abs(np.array(b["values"]) - np.array(r["values"])).max() <= {"float": 0, "fp8": 1 / 255, "fpn": 0.0101}[codec]
        assert not back


def test_source_by_name(spark, tmp_path):
    spark.dataSource.register(nvdb.NvdbSource)
    leaf = G.leaves(dense(spark, CASES["single leaf"][0])).withColumn("grid_id", F.lit("g"))
    nvdb.write(nvdb.to_images(leaf), str(tmp_path))
    assert spark.read.format("nvdb").load(str(tmp_path)).first()["voxel_count"] == leaf.first()["active_count"]
    assert spark.read.format("nvdb").option("table", "leaves").load(str(tmp_path)).count() == 1


def test_image_layout(spark):
    """Image sizes follow the format: the sphere's figures of the known sidecars for a given number of nodes."""
    assert 672 + 64 + 64 + 8 * 32 + 8 * 270400 + 8 * 33856 + 788 * 2144 == 4124576
    image = nvdb.grid_image([(0, 0, 0, np.ones(512), np.full(8, -1)), (-8, 0, 0, np.ones(512), np.full(8, -1))], background=2.0)
    assert len(image) == 672 + 64 + 64 + 2 * (32 + 270400 + 33856 + 2144) and len(image) % 32 == 0
    background, leaves, tiles = nvdb.walk(image)
    assert background == 2.0 and [x[:3] for x in leaves] == [(-8, 0, 0), (0, 0, 0)] and [(x[0], x[4], x[5]) for x in tiles] == [(2, 2.0, False), (1, 2.0, False)] * 2


@pytest.mark.parametrize("what", ["magic", "short", "cut", "size", "blosc", "version", "type", "bomb"])
def test_broken_files(spark, tmp_path, what):
    image = nvdb.grid_image([(0, 0, 0, np.ones(512), np.full(8, -1))])
    data = bytearray(nvdb.file_bytes([image], 1 if what == "bomb" else 0))
    if what == "magic":
        data[:8] = b"garbage!"
    elif what == "short":
        data = data[:9]
    elif what == "cut":
        data = data[:-100]
    elif what == "size":
        data[16:24] = (len(image) + 32).to_bytes(8, "little")
    elif what == "blosc":
        data[14] = 2
    elif what == "version":
        data[8:12] = (31 << 21).to_bytes(4, "little")
    elif what == "type":
        data[16 + 32] = 2
    elif what == "bomb":
        data[16:24] = (1000).to_bytes(8, "little")
    with pytest.raises(ValueError):
        list(nvdb.images(bytes(data)))
    (tmp_path / "x.nvdb").write_bytes(data)
    row = nvdb.read(spark, str(tmp_path), permissive=True).first()
    assert row["error"] and row["name"] is None


@pytest.mark.parametrize(("shape", "box", "active", "leaf"), [("sphere", ((-51,) * 3, (51,) * 3), 523305, 788), ("torus", ((-86, -26, -86), (86, 26, 86)), 738028, 1367), ("box", ((-41, -21, -31), (41, 21, 31)), 202581, 336)])
def test_primitives(spark, shape, box, active, leaf):
    """Active counts and leaf counts (constant leaves being tiles) of the known fog shapes."""
    rows = G.leaves(G.fog(spark, shape, *box)).persist()
    assert rows.agg(F.sum("active_count")).first()[0] == active
    assert rows.count() - G.constant_leaves(rows).count() == leaf
    rows.unpersist()


def test_codecs_match_the_model(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(40):
        v = [rng.random(512), rng.integers(0, 2, 512) * 0.5, np.full(512, 0.25), rng.random(512) * 100, rng.integers(0, 4, 512) / 3][i % 5]
        rows.append((i, 0, 0, v.astype(np.float32).tolist()))
    leaf = spark.createDataFrame(rows, "ox int, oy int, oz int, values array<float>")
    for codec in ("fp8", "fpn"):
        for r in C.quantize(leaf, codec).collect():
            bits, low, q, codes = nvdb.encode_leaf(np.array(rows[r["ox"]][3]), codec, 0.01)
            assert (r["bits"], np.float32(r["minimum"])) == (bits, np.float32(low)) and r["codes"] == codes.tolist()
            assert np.float32(r["quantum"]) == np.float32(q)


def test_probe_goldens(spark):
    """The first coordinates and points of a known seed."""
    low, high = (-10,) * 3, (10,) * 3
    got = [list(r)[1:] for r in K.probes(spark, 5, 0x1234567890ABCDEF, low, high).orderBy("probe_id").collect()]
    assert got == [[14, 0, -11], [-12, 1, 10], [9, 2, -11], [10, 3, 11], [0, 8, -3]]


def test_trilinear_properties(spark):
    rng = np.random.default_rng(3)
    v = rng.random((12, 12, 12))
    leaf = G.leaves(dense(spark, v))
    pts = rng.random((200, 3)) * 10
    pts[:50] = np.floor(pts[:50])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "probe_id long, x double, y double, z double")
    got = {r["probe_id"]: r["value"] for r in L.sample_trilinear(df, leaf).collect()}
    for i, p in enumerate(pts):
        b = np.floor(p).astype(int)
        taps = v[b[0] : b[0] + 2, b[1] : b[1] + 2, b[2] : b[2] + 2]
        assert taps.min() - 1e-6 <= got[i] <= taps.max() + 1e-6
        if i < 50:
            assert got[i] == np.float32(v[tuple(b)])


def test_masks(spark):
    rows = dense(spark, CASES["single leaf"][0])
    r = G.leaves(rows).select(M.ones(F.col("mask")).alias("ones"), M.count_bits(F.col("mask")).alias("n"), M.test_bit(F.col("mask"), F.lit(63)).alias("b")).first()
    want = np.flatnonzero(CASES["single leaf"][0].ravel()).tolist()
    assert (r["ones"], r["n"], r["b"]) == (want, len(want), 63 in want)


def test_nan_is_active_only_exactly(spark):
    v = spark.createDataFrame([(0, 0, 0, float("nan")), (1, 0, 0, 0.0)], "x int, y int, z int, value double")
    assert [r["active"] for r in G.with_active(v).orderBy("x").collect()] == [True, False]
    assert [r["active"] for r in G.with_active(v, 0.0, 0.5).orderBy("x").collect()] == [False, False]


def test_guards(spark):
    with pytest.raises(ValueError):
        G.check_dense([2, 2, 2], 7)
    with pytest.raises(ValueError):
        G.check_dense([2, 2, -1], 4)
    with pytest.raises(ValueError):
        G.uniform_scale([1, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1])
    with pytest.raises(ValueError):
        G.uniform_scale([1, 0.1, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1])
    t = spark.createDataFrame([(3, 0, 0, 0, 1.0, True)], "level int, ox int, oy int, oz int, value double, active boolean")
    with pytest.raises(Exception, match="active root tile"):
        G.tile_leaves(t).collect()


def test_transform_reads_no_leaves(spark):
    g = spark.createDataFrame([(0, 9, 0, 9, 0, 9, [1.0] * 10)], "min_x int, max_x int, min_y int, max_y int, min_z int, max_z int, heavy array<double>")
    out = G.transform_grids(g, 0.5, (1.0, 2.0, 3.0)).first()
    assert (out["world_min_x"], out["world_max_x"], out["world_max_z"]) == (1.0, 6.0, 8.0)


def test_rays_model(spark):
    v = np.zeros((8, 8, 8))
    v[4] = 1.0
    leaf = G.leaves(dense(spark, v))
    rays = spark.createDataFrame([(1, -2.0, 4.0, 4.0, 1.0, 0.0, 0.0), (2, -2.0, 50.0, 4.0, 1.0, 0.0, 0.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = R.clip(rays, (0, 0, 0), (7, 7, 7)).collect()
    assert [(r["ray_id"], r["t0"], r["t1"]) for r in got] == [(1, 2.0, 10.0)]
    out = R.render(rays, leaf, (0, 0, 0), (7, 7, 7), shadows=False).collect()
    assert len(out) == 1 and out[0]["colour"] > 0 and out[0]["transmittance"] < 0.01


def test_wireframe(spark):
    leaf = spark.createDataFrame([(8, 0, -8)], "ox int, oy int, oz int")
    e = R.wireframe(leaf, 0.5).collect()
    assert len({tuple(sorted([(r["from_x"], r["from_y"], r["from_z"]), (r["to_x"], r["to_y"], r["to_z"])])) for r in e}) == 12
    assert {r["from_x"] for r in e} == {4.0, 8.0}


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"fps": 12,\n "frames": ["a.nvdb", "/abs/b.nvdb"]}')
    got = [tuple(r) for r in S.manifest(spark, f"{tmp_path}/m.json").orderBy("frame").collect()]
    assert got == [(0, f"{tmp_path}/a.nvdb", 12.0), (1, "/abs/b.nvdb", 12.0)]


def test_mulberry32_by_integer_steps():
    from sparvox.functions.keys import mulberry32
    from sparvox.plans.queries import PHASES

    state, want = 1234, []
    for _ in range(3):
        state = (state + 0x6D2B79F5) % 2**32
        t = (state ^ state >> 15) * (state | 1) % 2**32
        t = (t + (t ^ t >> 7) * (t | 61)) % 2**32 ^ t
        want.append((t ^ t >> 14) / 2**32)
    assert np.allclose(mulberry32(1234, np.arange(1, 4)), want, atol=0)
    assert [f"({v!r}::DOUBLE * 2 * pi())" for v in want] == PHASES


def test_inactive_tiles_of_a_file(spark):
    """Inactive tiles at both levels are read where they differ from the background, and the first of them where they don't."""
    import struct

    from sparvox.operators import grids as G
    from sparvox.operators import lookup as L
    from sparvox.sources import nvdb as N

    values = np.ones(512, np.float32)
    image = bytearray(N.grid_image([(0, 0, 0, values, np.full(8, -1, np.int64))], name="g", background=0.5))
    background, leaves, tiles = N.walk(bytes(image))
    assert sorted(t[0] for t in tiles) == [1, 2] and all(t[4] == 0.5 and not t[5] for t in tiles)  # the first inactive ones
    root = N.GRID + struct.unpack_from("<Q", image, N.GRID + 24)[0]
    up = root + struct.unpack_from("<q", image, root + N.ROOT + 8)[0]
    low = up + struct.unpack_from("<q", image, up + 8256)[0]
    struct.pack_into("<f", image, up + 8256 + 8 * 3, 7.5)  # upper slot 3: (0, 0, 384)
    struct.pack_into("<f", image, low + 1088 + 8 * 2, 6.5)  # lower slot 2: (0, 0, 16)
    files = spark.createDataFrame([("a.nvdb", bytes(image)), ("b.txt", b"nothing of the kind")], "path string, content binary")
    t = N.tables(files.where("path = 'a.nvdb'"), "tiles")
    found = {tuple(r) for r in t.select("level", "ox", "oy", "oz", "value", "active").collect()}
    assert {(2, 0, 0, 384, 7.5, False), (1, 0, 0, 16, 6.5, False)} <= found
    leaf = N.load(files, "leaves", permissive=True)
    probes = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 20), (2, 0, 0, 30), (3, 5, 5, 400), (4, 0, 200, 0), (5, -1, 0, 0)], "probe_id long, x int, y int, z int")
    got = {r["probe_id"]: (r["value"], r["active"], r["level"]) for r in L.read_values(probes, leaf, 0.5, t).collect()}
    assert got == {0: (1.0, True, 0), 1: (6.5, False, 1), 2: (0.5, False, 1), 3: (7.5, False, 2), 4: (0.5, False, 2), 5: (0.5, False, 4)}
    assert G.effective_background(t, 0.5).first()["background"] == 0.5  # the first inactive lower tile: slot 1 holds the background
    grids = {r["path"]: (r["name"], r["error"]) for r in N.load(files, "grids", permissive=True).collect()}
    assert grids == {"a.nvdb": ("g", None), "b.txt": (None, "no known format")}
