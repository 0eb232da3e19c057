"""The scheduler with a clock of its own, and as a stream."""

import pytest

from sparvox.streaming.playback import START, Playback, play, rebind


def run(p, events):
    s = {k: list(v) if isinstance(v, list) else v for k, v in START.items()}
    return s, [r for r in (p.step(s, {"seq": i, "now_ms": t, "kind": k, "arg": a}) for i, (t, k, a) in enumerate(events)) if r]


def test_plays_wraps_and_stalls():
    p = Playback(frames=4, fps=10, ahead=1)
    s, out = run(p, [(0, "start", None), (0, "decoded", 0), (0, "tick", None), (100, "tick", None), (100, "decoded", 1), (150, "tick", None), (420, "tick", None), (430, "tick", None), (430, "decoded", 2)])
    # start itself stalls, as frame 0 is not there; so does the tick at frame 1. Frame 0 is held again only when it is decoded once more.
    assert [(r["frame"], r["stalls"], r["rebinds"]) for r in out] == [(0, 1, 1), (0, 2, 1), (1, 2, 2), (1, 3, 2), (1, 4, 2)]
    assert 1 in s["held"] and 2 in s["held"]  # the one shown, and one that was asked for and came


def test_shown_frame_stays_in_the_ring():
    p = Playback(frames=10, fps=10, ahead=1)
    s, out = run(p, [(0, "preload", 3), (0, "decoded", 0), (0, "decoded", 1), (0, "decoded", 2), (0, "start", None), (500, "tick", None)])
    assert out[0]["frame"] == 0 and 0 in s["held"] and 2 not in s["held"] and set(s["asked"]) == {5, 6}
    assert out[0]["decoded_ahead"] == 0 and out[0]["stalls"] == 1


def test_warm_start_has_no_stalls():
    p = Playback(frames=6, fps=10, ahead=2)
    events = [(0, "preload", None), *[(0, "decoded", i) for i in range(3)], (0, "start", None)]
    events += [x for i in range(1, 6) for x in ((100 * i, "tick", None), (100 * i, "decoded", (i + 2) % 6))]
    _, out = run(p, events)
    assert [(r["frame"], r["stalls"]) for r in out] == [(i, 0) for i in range(1, 6)]


def test_clamps_seeks_stops_and_resumes():
    p = Playback(frames=3, fps=10, loop=False, ahead=2)
    events = [(0, "start", None), *[(0, "decoded", i) for i in range(3)], (5000, "tick", None), (5000, "seek", 1), (5000, "decoded", 1), (5001, "tick", None), (5001, "stop", None), (9000, "tick", None), (9000, "resume", None), (9050, "tick", None), (9150, "tick", None)]
    s, out = run(p, events)
    assert [r["frame"] for r in out] == [2, 1, 1, 1, 2]
    assert [r["stalls"] for r in out] == [1, 2, 2, 2, 2]  # the start's and the seek's
    assert p.step(s, {"seq": 99, "now_ms": 9999, "kind": "start", "arg": None}) is None
    assert (s["shown"], s["stalls"], s["rebinds"]) == (-1, 1, 0)


def test_seeks_wrap_and_resume_needs_a_start():
    p = Playback(frames=4, fps=10, ahead=0)
    s, out = run(p, [(0, "resume", None), (0, "tick", None), (0, "seek", 6), (0, "decoded", 2), (5, "tick", None), (5, "start", None), (6, "seek", -1), (6, "decoded", 3), (7, "tick", None)])
    assert [r["frame"] for r in out] == [-1, -1, 3] and out[1]["stalls"] == 0


def test_dispose_drops_everything():
    p = Playback(frames=8, ahead=3)
    s, out = run(p, [(0, "start", None), (1, "decoded", 0), (2, "tick", None), (3, "dispose", None), (4, "tick", None)])
    assert (s["held"], s["asked"], s["playing"]) == ([], [], False) and out[-1]["frame"] == 0


def test_asks_once_and_counts_failures():
    p = Playback(frames=8, ahead=3)
    s, _ = run(p, [(0, "start", None), (1, "tick", None), (2, "tick", None), (3, "failed", 0)])
    assert s["errors"] == 1 and 0 not in s["asked"] and len(s["asked"]) == len(set(s["asked"])) == 3
    p.step(s, {"seq": 9, "now_ms": 4, "kind": "tick", "arg": None})
    assert 0 in s["asked"]


def test_rebind():
    a = {"grid_type": "Float", "grid_bytes": 10, "capacity": 20}
    assert rebind(a, {"grid_type": "Float", "grid_bytes": 20})["capacity"] == 20
    for bad in ({"grid_type": "Fp8", "grid_bytes": 5}, {"grid_type": "Float", "grid_bytes": 21}):
        with pytest.raises(ValueError):
            rebind(a, bad)


def test_stream(spark, tmp_path):
    schema = "player string, seq long, now_ms long, kind string, arg long"
    rows = [("p", 0, 0, "start", 0), ("p", 1, 0, "decoded", 0), ("p", 2, 10, "tick", 0), ("q", 0, 0, "start", 0), ("q", 1, 5, "tick", 0)]
    more = [("p", 3, 130, "tick", 0), ("p", 4, 130, "decoded", 1), ("p", 5, 140, "tick", 0)]
    for i, part in enumerate((rows, more)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = play(spark.readStream.schema(schema).json(str(tmp_path / "in")), Playback(frames=5, fps=10)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
    got = sorted((r["player"], r["seq"], r["frame"], r["stalls"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("p", 2, 0, 1), ("p", 3, 0, 2), ("p", 5, 1, 2), ("q", 1, -1, 2)]
