"""A playback scheduler over a stream of control events and ticks, with its ring of decoded frames as keyed state.

Events (player, seq, now_ms, kind, arg): start, stop, resume, seek (to frame arg), preload (the first arg frames, by default the
first and those ahead of it), dispose, decoded (frame arg), failed (frame arg) and tick. Every tick gives a row (player, seq,
frame, decoded_ahead, stalls, rebinds, in_flight, errors).

start begins anew at frame 0 with its counters at 0; resume goes on from the frame shown. Whatever asks for a frame that is not
decoded, be it a tick, a start or a seek, counts a stall, and the frame shown stays; it is kept in the ring as well."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

OUT = "player string, seq long, frame int, decoded_ahead int, stalls int, rebinds int, in_flight int, errors int"


@dataclass(frozen=True)
class Playback:
    frames: int
    fps: float = 24.0
    loop: bool = True
    ahead: int = 3

    def wrap(self, i: int) -> int:
        return i % self.frames if self.loop else max(0, min(i, self.frames - 1))

    def following(self, frame: int, first: int = 0) -> list[int]:
        """The frame (or the one `first` after it) and those ahead of it; without a loop they end with the last."""
        return [self.wrap(frame + k) for k in range(first, self.ahead + 1) if self.loop or frame + k < self.frames]

    def fetch(self, s: dict, frame: int) -> None:
        """Ask for the frames from this one on that are neither held nor under way; let go of others, but not of the one shown."""
        want = dict.fromkeys(self.following(frame) + ([s["shown"]] if s["shown"] >= 0 else []))
        self.ask(s, list(want))
        s["held"] = [f for f in s["held"] if f in want]

    def ask(self, s: dict, frames: list[int]) -> None:
        s["asked"] += [f for f in frames if f not in s["held"] and f not in s["asked"]]

    def show(self, s: dict, frame: int) -> None:
        if frame == s["shown"]:
            return
        if frame in s["held"]:
            s["shown"], s["rebinds"] = frame, s["rebinds"] + 1
        else:
            s["stalls"] += 1
        self.fetch(s, frame)

    def step(self, s: dict, e: dict) -> dict | None:
        kind, arg = e["kind"], e["arg"]
        arg = None if arg is None or arg != arg else int(arg)
        if kind == "start":
            s.update(begun=True, playing=True, since=e["now_ms"], first=0, shown=-1, stalls=0, rebinds=0)
            self.fetch(s, 0)
            self.show(s, 0)
        elif kind == "stop":
            s["playing"] = False
        elif kind == "resume" and s["begun"]:
            s.update(playing=True, since=e["now_ms"], first=max(s["shown"], 0))
        elif kind == "seek":
            s.update(first=self.wrap(arg or 0), since=e["now_ms"])
            self.fetch(s, s["first"])
            if s["begun"]:
                self.show(s, s["first"])
        elif kind == "preload":
            self.ask(s, list(range(min(self.ahead + 1 if arg is None else arg, self.frames))))
        elif kind == "dispose":
            s.update(playing=False, held=[], asked=[])
        elif kind in ("decoded", "failed") and arg in s["asked"]:
            s["asked"].remove(arg)
            if kind == "decoded":
                s["held"].append(arg)
        s["errors"] += kind == "failed"  # such a frame is asked for again when it is next wanted
        if kind != "tick":
            return None
        if s["playing"]:
            due = s["first"] + int((e["now_ms"] - s["since"]) // (1000.0 / self.fps))
            due = self.wrap(due)
            if due == s["shown"]:
                self.fetch(s, due)
            self.show(s, due)
        ahead = len(s["held"]) if s["shown"] < 0 else sum(f in s["held"] for f in self.following(s["shown"], 1))
        return {"seq": e["seq"], "frame": s["shown"], "decoded_ahead": ahead, "stalls": s["stalls"], "rebinds": s["rebinds"], "in_flight": len(s["asked"]), "errors": s["errors"]}


START = {"begun": False, "playing": False, "since": 0, "first": 0, "held": [], "asked": [], "shown": -1, "stalls": 0, "rebinds": 0, "errors": 0}


def play(events: DataFrame, how: Playback) -> DataFrame:
    """The rows of all ticks of a stream of events; players are independent keys, their events in the order of seq within a batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {k: list(v) if isinstance(v, list) else v for k, v in START.items()}
        rows = pd.concat(list(batches)).sort_values("seq")
        made = [r for r in (how.step(s, e) for e in rows.to_dict("records")) if r]
        state.update((json.dumps(s),))
        if made:
            yield pd.DataFrame(made).assign(player=key[0])[[c.split()[0] for c in OUT.split(", ")]]

    return events.groupBy("player").applyInPandasWithState(run, OUT, "s string", "append", "NoTimeout")


def rebind(current: dict, new: dict) -> dict:
    """Replace a bound grid in place: the same type, and no larger than the capacity."""
    if current["grid_type"] != new["grid_type"]:
        raise ValueError(f"cannot bind a {new['grid_type']} grid in place of {current['grid_type']}")
    if new["grid_bytes"] > current["capacity"]:
        raise ValueError(f"{new['grid_bytes']} bytes do not fit the capacity of {current['capacity']}")
    return {**new, "capacity": current["capacity"]}
