"""Stateful filters of frame streams: throttle, corner smoothing, focus score, guidance states and spoken hints.

Each filter is a pure step: state and frame in, state and result out. replay() runs it over a sorted batch, one key
after the other, with one state in memory; stream() runs the same step in Structured Streaming, where the state
lives in the state store. Frames of a micro-batch are sorted by time first, and late ones meet the filter's own rule.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------------------
FRAME_MS, DETECT_MS = 180, 250
MIN_CUTOFF, BETA, D_CUTOFF, JUMP = 1.0, 0.05, 1.0, 0.25
VARIANCE_FLOOR, HALF_LIFE_MS, SCORE_ALPHA = 5.0, 10_000, 0.35
WINDOW, STABLE_HINT, STABLE_READY, ENTER, LEAVE_READY = 10, 2, 8, 2, 3
SNAP_ENTER, SNAP_LEAVE = 1.5, 3.0
RATE_MS, OK_REPEAT_MS, READY_QUALITY, TOO_FAR_DIOPTERS = 1200, 5000, 0.80, 1.0
SYSTEM = ("CAMERA_READY", "LOW_LIGHT", "FLASHLIGHT_ON", "FLASHLIGHT_OFF")
TIPS = ("ORIENTATION_PORTRAIT_TIP", "ORIENTATION_LANDSCAPE_TIP")
HINTS = ("TILT_LEFT", "TILT_RIGHT", "TILT_FORWARD", "TILT_BACK", "MOVE_LEFT", "MOVE_RIGHT", "MOVE_UP", "MOVE_DOWN", "MOVE_CLOSER", "MOVE_BACK", "TOO_FAR", *TIPS, "OK")
# ----------------------------------------------------------------------------------------------------------------

State = dict[str, Any] | None
Step = Callable[[State, dict[str, Any]], tuple[State, dict[str, Any] | None]]


def throttle(every_ms: int = FRAME_MS, repeat: bool = False) -> Step:
    """Frames less than every_ms after the last that passed are dropped, or answered with that one's value."""

    def step(state: State, frame: dict) -> tuple[State, dict | None]:
        if state is not None and frame["ts_ms"] - state["ts_ms"] < every_ms:
            return state, {"value": state["value"], "fresh": False} if repeat else None
        return {"ts_ms": frame["ts_ms"], "value": frame["value"]}, {"value": frame["value"], "fresh": True}

    return step


def alpha(rate: float, cutoff: float) -> float:
    """Smoothing coefficient of a low-pass filter at a sampling rate."""
    return 1.0 / (1.0 + rate / (2.0 * math.pi * cutoff))


def one_euro(min_cutoff: float = MIN_CUTOFF, beta: float = BETA, d_cutoff: float = D_CUTOFF, jump: float = JUMP) -> Step:
    """Adaptive low-pass over a flat list of coordinates: the faster an axis moves, the less it is smoothed.

    A failed frame (corners null) resets; so does a move of `jump` of the diagonal. A frame that isn't later than
    the last gets the last estimate and changes nothing.
    """

    def step(state: State, frame: dict) -> tuple[State, dict | None]:
        raw = frame["corners"]
        if raw is None:
            return None, {"corners": None}
        raw = [float(x) for x in raw]
        first = {"x": raw, "dx": [0.0] * len(raw), "ts_ms": frame["ts_ms"]}
        if state is None:
            return first, {"corners": raw}
        moves = [math.hypot(raw[k] - state["x"][k], raw[k + 1] - state["x"][k + 1]) for k in range(0, len(raw), 2)]
        if max(moves) >= jump * math.hypot(frame["image_w"], frame["image_h"]):
            return first, {"corners": raw}
        seconds = (frame["ts_ms"] - state["ts_ms"]) / 1000.0
        if seconds <= 0:
            return state, {"corners": state["x"]}
        rate = 1.0 / seconds
        xs, dxs = [], []
        for x, before, speed in zip(raw, state["x"], state["dx"], strict=True):
            a = alpha(rate, d_cutoff)
            dx = a * (x - before) * rate + (1 - a) * speed
            a = alpha(rate, min_cutoff + beta * abs(dx))
            xs.append(a * x + (1 - a) * before)
            dxs.append(dx)
        return {"x": xs, "dx": dxs, "ts_ms": frame["ts_ms"]}, {"corners": xs}

    return step


def focus(state: State, frame: dict) -> tuple[State, dict]:
    """Sharpness against a maximum that halves in ten seconds, smoothed."""
    v, now = max(0.0, frame["value"]), frame["ts_ms"]
    most, score = VARIANCE_FLOOR, None
    if state is not None:
        most, score = state["most"], state["score"]
        if now > state["ts_ms"]:
            most = max(VARIANCE_FLOOR, most * 0.5 ** ((now - state["ts_ms"]) / HALF_LIFE_MS))
    most = max(most, v)
    now_score = min(1.0, v / most)
    score = now_score if score is None else SCORE_ALPHA * now_score + (1 - SCORE_ALPHA) * score
    return {"most": most, "score": score, "ts_ms": now}, {"score": score}


def _stable(history: list, n: int, same: Callable[[list], bool]) -> bool:
    return len(history) >= n and same(history[-n:])


def _next_state(s: dict, plausible: bool, guided: bool, ready: bool, quality: float) -> None:
    """The four states NO_DOC, DOC_UNSTABLE, DOC_ALIGNING and READY; counters keep them from flickering."""
    now = s["state"]
    if now == "NO_DOC":
        s["good"] = s["good"] + 1 if plausible else 0
        if s["good"] >= ENTER:
            s["state"], s["good"] = "DOC_UNSTABLE", 0
        return
    if now == "READY":
        if plausible and quality >= READY_QUALITY:
            s["bad"] = 0
            return
        s["bad"] += 1
        if s["bad"] >= LEAVE_READY:
            s["state"], s["bad"] = "NO_DOC" if not plausible else "DOC_ALIGNING" if guided else "DOC_UNSTABLE", 0
        return
    if not plausible:
        s["bad"] += 1
        if s["bad"] >= ENTER:
            s["state"], s["bad"] = "NO_DOC", 0
        return
    s["bad"] = 0
    if now == "DOC_UNSTABLE":
        s["state"] = "DOC_ALIGNING" if guided else now
    elif ready and quality >= READY_QUALITY:
        s["state"] = "READY"
    elif not guided:
        s["state"] = "DOC_UNSTABLE"


def _event(s: dict, before: str, plausible: bool, hint: str | None, now: int) -> str | None:
    """What there is to say: entering READY, hold still, a tip without a page, or the hint once it is stable."""
    state = s["state"]
    if state == "READY" and before != "READY":
        return "READY_ENTER"
    if state == "DOC_UNSTABLE":
        return "HOLD_STILL"
    if state == "NO_DOC":
        return hint if hint in TIPS else None
    if s["same"] < STABLE_HINT or hint not in HINTS:
        return None
    if hint in ("MOVE_CLOSER", "MOVE_BACK") and not plausible:
        return None
    if hint == "OK" and now - s["ok_ms"] < OK_REPEAT_MS:
        return None
    return hint


def _may_say(s: dict, event: str, now: int) -> bool:
    """Entering READY always; system events past the rate limit; the same event, but for OK, after twice the limit."""
    since = now - s["said_ms"]
    if event == "READY_ENTER":
        return True
    if since < RATE_MS:
        return event in SYSTEM
    return event == "OK" or event != s["said"] or since >= 2 * RATE_MS


def guidance(state: State, frame: dict) -> tuple[State, dict | None]:
    """States and events of frames (plausible, quality, hint, has_quad, too_small, diopters) and of system events (event)."""
    s = state or {"state": "NO_DOC", "history": [], "good": 0, "bad": 0, "said_ms": 0, "said": None, "ok_ms": 0, "hint": None, "same": 0}
    s = dict(s, history=list(s["history"]))
    now, event = frame["ts_ms"], frame.get("event")
    if event is None:
        plausible, quality, hint = bool(frame["plausible"]), float(frame["quality"] or 0.0), frame["hint"]
        far = 0 < (frame["diopters"] or 0) < TOO_FAR_DIOPTERS and not frame["has_quad"]
        if not plausible and (frame["too_small"] or far):
            hint = "TOO_FAR"
        s["history"] = [*s["history"], [quality, hint]][-WINDOW:]
        one_hint = lambda h: len({x[1] for x in h}) == 1
        guided = _stable(s["history"], STABLE_HINT, one_hint)
        ready = _stable(s["history"], STABLE_READY, lambda h: one_hint(h) and min(x[0] for x in h) >= READY_QUALITY)
        s["same"] = s["same"] + 1 if hint == s["hint"] else 1
        s["hint"] = hint
        before = s["state"]
        _next_state(s, plausible, guided, ready, quality)
        event = _event(s, before, plausible, hint, now)
    if event is not None and _may_say(s, event, now):
        s["said_ms"], s["said"] = now, event
        if event == "OK" and frame.get("event") is None:
            s["ok_ms"] = now
    else:
        event = None
    return s, {"state": s["state"], "event": event}


def spoken_hints(rate_ms: int = 1200, stable: int = 2, ok_repeat_ms: int = 6000) -> Step:
    """A hint is spoken once it is stable, at most every rate_ms, the same one every second time, OK when it is new or old."""

    def step(state: State, frame: dict) -> tuple[State, dict | None]:
        hint = frame["hint"] or "OK"
        s = dict(state or {"hint": None, "n": 0, "said_ms": 0, "said": None})
        s["n"], s["hint"] = (s["n"] + 1 if hint == s["hint"] else 1), hint
        since = frame["ts_ms"] - s["said_ms"]
        again = hint == s["said"]
        if s["n"] < max(1, stable) or since < max(0, rate_ms) or again and (since < 2 * rate_ms or hint == "OK" and since < max(1000, ok_repeat_ms)):
            return s, None
        s["said_ms"], s["said"] = frame["ts_ms"], hint
        return s, {"hint": hint}

    return step


def _rows(step: Step, state: State, frames: pd.DataFrame, key: str, out: list[str]) -> tuple[State, list[tuple]]:
    rows = []
    for frame in frames.to_dict("records"):
        state, result = step(state, frame)
        if result is not None:
            rows.append((frame[key], frame["ts_ms"], *(result[c] for c in out)))
    return state, rows


def replay(frames: DataFrame, key: str, step: Step, schema: str, order: tuple[str, ...] = ("ts_ms",)) -> DataFrame:
    """The step over each key's frames in order; schema: that of the results. Result: key, ts_ms and the results."""
    names = [c.split()[0] for c in schema.split(", ")]
    key_type = frames.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            rows: list[tuple] = []
            for k, part in b.groupby(key, sort=False, dropna=False):
                if now is None or k != now[0]:
                    now, state = (k,), None
                state, new = _rows(step, state, part, key, names)
                rows += new
            yield pd.DataFrame(rows, columns=[key, "ts_ms", *names])

    return frames.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{key} {key_type}, ts_ms long, {schema}")


def stream(frames: DataFrame, key: str, step: Step, schema: str) -> DataFrame:
    """The step over a streaming DataFrame; its state is kept as JSON in the state store."""
    names = [c.split()[0] for c in schema.split(", ")]
    key_type = frames.schema[key].dataType.simpleString()

    def run(_: tuple, batches: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        state = json.loads(store.get[0]) if store.exists else None
        frames_ = pd.concat(list(batches)).sort_values("ts_ms", kind="stable")
        state, rows = _rows(step, state, frames_, key, names)
        store.update((json.dumps(state),))
        yield pd.DataFrame(rows, columns=[key, "ts_ms", *names])

    return frames.groupBy(key).applyInPandasWithState(run, f"{key} {key_type}, ts_ms long, {schema}", "state string", "append", "NoTimeout")


def snap(enter: float = SNAP_ENTER, leave: float = SNAP_LEAVE) -> Step:
    """A dragged corner drawn to the axes through its two neighbours: frames have corners (8 numbers), index (0 to 3), x and y.

    An edge takes hold at `enter` degrees from an axis and lets go beyond `leave`; which edges hold is the state, and another
    index starts anew. Two edges on the same axis don't both hold: the nearer does. Where the drawn place makes the quad
    anything but strictly convex, the corner stays where it was dragged to and both edges let go.
    """

    def off_axis(fixed: tuple[float, float], x: float, y: float) -> float | None:
        dx, dy = abs(x - fixed[0]), abs(y - fixed[1])
        if not dx and not dy:
            return None
        angle = math.degrees(math.atan2(dy, dx))
        return min(angle, 90.0 - angle)

    def convex(q: list[tuple[float, float]]) -> bool:
        turns = [(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in ((q[i], q[(i + 1) % 4], q[(i + 2) % 4]) for i in range(4))]
        return all(t > 0 for t in turns) or all(t < 0 for t in turns)

    def step(state: State, frame: dict) -> tuple[State, dict | None]:
        corners, index, x, y = frame["corners"], frame["index"], frame["x"], frame["y"]
        if corners is None or len(corners) != 8 or index is None or not 0 <= index < 4:
            return None, {"x": x, "y": y, "prev": False, "next": False}
        x, y, index = float(x), float(y), int(index)
        quad = [(float(corners[2 * k]), float(corners[2 * k + 1])) for k in range(4)]
        held = state if state is not None and state["index"] == index else {"prev": False, "next": False}
        sides = {"prev": quad[(index + 3) % 4], "next": quad[(index + 1) % 4]}
        off = {k: off_axis(p, x, y) for k, p in sides.items()}
        holds = {k: v is not None and v <= (leave if held[k] else enter) for k, v in off.items()}
        flat = {k: abs(x - p[0]) >= abs(y - p[1]) for k, p in sides.items()}
        if all(holds.values()) and flat["prev"] == flat["next"]:
            holds["next" if off["prev"] <= off["next"] else "prev"] = False
        at = [x, y]
        for k, p in sides.items():
            if holds[k]:
                level = abs(at[0] - p[0]) >= abs(at[1] - p[1])
                at[level] = p[level]
        if any(holds.values()):
            quad[index] = (at[0], at[1])
            if not convex(quad):
                at, holds = [x, y], {"prev": False, "next": False}
        return {"index": index, **holds}, {"x": at[0], "y": at[1], **holds}

    return step


def first_success(*candidates: tuple[Column, Column]) -> Column:
    """The first candidate (success, value) that succeeded."""
    return F.coalesce(*(F.when(ok, value) for ok, value in candidates))


def in_flight(requests: DataFrame, cancelled: DataFrame, key: str = "page_id", ts: str = "ts", within: str = "10 minutes") -> DataFrame:
    """Requests without repeats of a key within a time and without cancelled keys; works on batches and streams."""
    live = requests.join(cancelled.select(key).distinct(), key, "left_anti")
    return live.withWatermark(ts, within).dropDuplicatesWithinWatermark([key]) if live.isStreaming else live.dropDuplicates([key])
