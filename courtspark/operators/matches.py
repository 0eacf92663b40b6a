"""Whole matches at a time: the detectors of ``plays`` as array scans over the rows of many matches.

A match comes as one row with the list of its rows. A task lays some dozen matches end to end and goes from rows to
plays without another shuffle: nothing between rows and plays is written or dealt. Rules are those of ``segments`` and
``plays``, whose DataFrame forms serve single steps; ``tests/test_matches.py`` compares both.

Arrays hold a value for each row unless said; ``lo`` and ``hi`` bound the segment, pair or match of a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice, repeat
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import plays as Y
from .scans import bound, commonest, pushes_taken, run_ins_taken, runs, smoothed, spread, taken
from .segments import TAIL, _hung

#: Entries of the lists of matches that are laid end to end at a time (a match stays whole).
CHUNK = 20_000
ROLES = tuple(Y.SLOTS)
PIVOT = ROLES.index(Y.PIVOT)
#: Detectors in the order of their events' ``source``; a context's source is -1.
DETECTORS = ("swaps", "run_ins", "pushes", "breaks", "role_swaps", "role_runins")
FOUND = (
    f"match_id string, source int, play_type string, team string, start_frame int, end_frame int, t0 double, t1 double, confidence double, seg_ids array<int>, track_ids array<int>, goal_x double, variant string, "
    f"measures map<string, double>, roles {Y.ROLES_HELD}, tracks array<struct<track_id: int, points: array<array<double>>>>"
)


def packed(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """One row a match with the list of its rows; dealt by match over ``parts`` partitions, where that is given."""
    dealt = rows.repartition(parts, "match_id") if parts else rows
    return dealt.groupBy("match_id").agg(F.collect_list(F.struct("frame_id", "timestamp_s", "track_id", "team", "x", "y")).alias("rows"))


def match_rows(batch: pa.RecordBatch) -> SimpleNamespace:
    """The rows of ``packed`` matches."""
    held = batch.column(1)
    flat = held.flatten()
    frame, t, track, x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("frame_id", "timestamp_s", "track_id", "x", "y"))
    code = flat.field("team").dictionary_encode()
    of = code.indices.fill_null(len(code.dictionary)).to_numpy(zero_copy_only=False)
    m = np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy(zero_copy_only=False))
    return rows_of(batch.column(0), m, track, frame, t, [*code.dictionary.to_pylist(), None], of, x, y)


def rows_of(ids: pa.Array, m: np.ndarray, track: np.ndarray, frame: np.ndarray, t: np.ndarray, names: list[str | None], team: np.ndarray, x: np.ndarray, y: np.ndarray) -> SimpleNamespace:
    """Rows in order of match, track and frame; teams by number: A is 0, B is 1."""
    teams = ["A", "B", *sorted((n for n in names if n not in ("A", "B")), key=lambda n: (n is None, n))]
    team = np.array([teams.index(n) for n in names], np.int64)[team] if len(names) else team
    after = [v[1:] - v[:-1] for v in (m, track, frame)]
    sorted_ = ((after[0] > 0) | (after[0] == 0) & ((after[1] > 0) | (after[1] == 0) & (after[2] > 0))).all()
    order = slice(None) if sorted_ else np.lexsort((team, y, x, t, frame, track, m))
    pick = lambda v: np.asarray(v)[order]
    return SimpleNamespace(ids=ids, m=pick(m), track=pick(track), frame=pick(frame).astype(np.int64), t=pick(t).astype(float), teams=teams, team=pick(team), x=pick(x).astype(float), y=pick(y).astype(float))


def segments_of(r: SimpleNamespace) -> SimpleNamespace:
    """Segments as ``build_segments`` and ``with_movement`` make them: rows in order of match, segment and frame."""
    new = np.ones(len(r.t), bool)
    new[1:] = (r.m[1:] != r.m[:-1]) | (r.track[1:] != r.track[:-1]) | (np.diff(r.t) > 1.0)
    of, first = np.cumsum(new) - 1, np.flatnonzero(new)
    ends = np.append(first[1:], len(new))
    if (np.diff(r.t)[~new[1:]] > 0).all():
        a, z = first, ends - 1
    else:
        by_time = np.lexsort((r.y, r.x, r.t, of))
        a, z = by_time[first], by_time[ends - 1]
    names = np.array(r.teams, object)
    held, own = names[r.team].tolist(), names[commonest(of, r.team)]
    turn = np.lexsort((r.t[a], r.m[first]))
    tails = (held[max(i, j - TAIL) : j] for i, j in zip(first[turn].tolist(), ends[turn].tolist(), strict=True))
    each = zip(*(v[k[turn]].tolist() for k in (a, z) for v in (r.t, r.x, r.y)), own[turn].tolist(), tails, strict=True)
    chain = np.empty(len(first), np.int64)
    chain[turn] = np.array([k for n in np.bincount(r.m[first]).tolist() for k in _hung(islice(each, n))], np.int64)

    seg = chain[of]
    order = np.lexsort((r.frame, seg, r.m))
    lo, hi = runs(r.m[order], seg[order])
    long = (hi - lo >= 5) & (np.maximum.reduceat(r.t[order], lo) - np.minimum.reduceat(r.t[order], lo) >= 1.0)
    order = order[np.repeat(long, hi - lo)]
    m, seg, track, team = r.m[order], seg[order], r.track[order], r.team[order]
    lo, hi = runs(m, seg)
    s = np.repeat(np.arange(len(lo)), hi - lo)
    g = SimpleNamespace(s=s, m=m[lo], id=seg[lo], first=lo, past=hi, track=commonest(s, track), team=commonest(s, team), teams=r.teams, frame=r.frame[order], t=r.t[order], lo=lo[s], hi=hi[s])
    g.x, g.y = (smoothed(v[order], g.lo, g.hi) for v in (r.x, r.y))
    at = np.arange(len(s))
    then, ago = np.minimum(at + 1, g.hi - 1), np.maximum(at - 1, g.lo)
    took = g.t[then] - g.t[ago]
    vx, g.vy = (np.divide(v[then] - v[ago], took, out=np.zeros(len(s)), where=took > 0) for v in (g.x, g.y))
    g.v = np.sqrt(vx * vx + g.vy * g.vy)
    g.start, g.end = (f.reduceat(g.t, lo) if len(lo) else np.empty(0) for f in (np.minimum, np.maximum))
    # samples of a segment by time; nearly always that is their order
    g.by_time = at if (np.diff(g.t)[s[1:] == s[:-1]] > 0).all() else np.lexsort((g.y, g.x, g.t, s))
    _movement(g)
    return g


def _movement(g: SimpleNamespace, rest: float = 0.8, reach: int = 3000) -> None:
    """Adds begun and ended, the times between which a sample's movement lies, and begun_frame."""
    at, fast = np.arange(len(g.s)), g.v >= rest
    begins, ends = np.ones(len(at), bool), np.ones(len(at), bool)
    begins[1:], ends[:-1] = (g.s[1:] != g.s[:-1]) | ~fast[:-1], (g.s[1:] != g.s[:-1]) | ~fast[1:]
    back, on = np.maximum.accumulate(np.where(begins, at, 0)), np.minimum.accumulate(np.where(ends, at, len(at))[::-1])[::-1]
    ms = np.copysign(np.floor(np.abs(g.t * 1000) + 0.5), g.t).astype(np.int64)
    by, place = g.by_time, np.empty(len(at), np.int64)
    place[by] = at
    sorted_ms, sorted_t, sorted_frame = ms[by], g.t[by], g.frame[by]
    a = bound(g.lo, g.hi, lambda q: sorted_ms[q] < ms - reach)
    z = bound(g.lo, g.hi, lambda q: sorted_ms[q] <= ms + reach) - 1
    here = bound(g.lo, g.hi, lambda q: sorted_ms[q] <= ms)
    frame0 = sorted_frame[a]
    if by is not at:
        of, q = spread(a, here)
        np.minimum.at(frame0, of, sorted_frame[q])
    g.begun, g.ended = np.maximum(g.t[back], sorted_t[a]), np.minimum(g.t[on], sorted_t[z])
    g.begun_frame = np.maximum(g.frame[back], frame0)


def sample_at(g: SimpleNamespace, seg: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The row of a segment's first sample at or after a time, else of its last."""
    sorted_t = g.t[g.by_time]
    return g.by_time[np.minimum(bound(g.first[seg], g.past[seg], lambda q: sorted_t[q] < t), g.past[seg] - 1)]


def contexts_of(r: SimpleNamespace, strong: float = 1.0, hold: int = 2, pause_s: float = 2.0, least: int = 3, near: float = 14.0) -> SimpleNamespace:
    """Attack contexts as ``attack_verdicts``, ``attack_hysteresis`` and ``attack_contexts`` find them, in order of
    match and start: m, goal, team, start, end; ``lo`` and ``hi`` bound a match's."""
    second = np.floor(r.t).astype(np.int64)
    k = np.flatnonzero((r.team < 2) & (second >= 0))
    k = k[np.lexsort((r.x[k], second[k], r.m[k]))]
    lo, hi = runs(r.m[k], second[k])
    of = np.repeat(np.arange(len(lo)), hi - lo)
    mid = r.x[k][lo + (hi - lo) // 2]
    goal = np.where(mid < near, 0.0, np.where(mid > 40 - near, 40.0, np.nan))
    n = [np.bincount(of[r.team[k] == c], minlength=len(lo)) for c in (0, 1)]
    far = np.abs(r.x[k] - goal[of])
    with np.errstate(invalid="ignore", divide="ignore"):
        away = [np.bincount(of[r.team[k] == c], far[r.team[k] == c], len(lo)) / n[c] for c in (0, 1)]
    clear = np.flatnonzero((n[0] >= least) & (n[1] >= least) & ~np.isnan(goal))
    seen = np.where(np.abs(away[0] - away[1]) >= strong, np.where(away[0] > away[1], 0, 1), -1)
    out, before, label, last, run = [], None, -1, -1, 0
    for m, b, z, v in zip(r.m[k][lo][clear].tolist(), second[k][lo][clear].tolist(), goal[clear].tolist(), seen[clear].tolist(), strict=True):
        if before != (m, b - 1, z):
            label, last, run = -1, -1, 0
        before, run, last = (m, b, z), run + 1 if v == last else 1, v
        if v >= 0 and (run >= hold or label < 0):
            label = v
        if label >= 0:
            if out and out[-1][:3] == [m, z, label] and b - out[-1][4] <= pause_s:
                out[-1][4] = b + 1.0
            else:
                out.append([m, z, label, float(b), b + 1.0])
    m, z, team, start, end = (np.array([c[i] for c in out], kind) for i, kind in enumerate((np.int64, float, np.int64, float, float)))
    edge = np.searchsorted(m, np.arange(len(r.ids) + 1))
    return SimpleNamespace(m=m, goal=z, team=team, start=start, end=end, lo=edge[:-1], hi=edge[1:])


def context_at(c: SimpleNamespace, m: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The context that holds a time, or -1."""
    if not len(c.m):
        return np.full(len(m), -1)
    k = bound(c.lo[m], c.hi[m], lambda q: c.start[q] <= t) - 1
    return np.where((k >= c.lo[m]) & (t < c.end[np.maximum(k, 0)]), k, -1)


def goal_far(x: np.ndarray, y: np.ndarray, goal: np.ndarray | float) -> np.ndarray:
    return np.sqrt((x - goal) * (x - goal) + (y - 10) * (y - 10))


def _attacks(g: SimpleNamespace, c: SimpleNamespace) -> None:
    """Adds the goal that a sample's own team attacks then (else nan), its number, and the distances to both goals."""
    k = context_at(c, g.m[g.s], g.t)
    own = k >= 0
    own[own] = c.team[k[own]] == g.team[g.s[own]]
    g.goal = np.full(len(k), np.nan)
    g.goal[own] = c.goal[k[own]]
    g.side = (g.goal == 40).astype(np.int64)
    g.d = np.stack([goal_far(g.x, g.y, z) for z in (0.0, 40.0)])


def pairs_of(g: SimpleNamespace, overlap_s: float = 0.8) -> SimpleNamespace:
    """Samples of two team mates in the same frames, in order of pair and frame: rows a and b, the time and how far apart
    they are across the court, also in order of time; first, past, shared (seconds), by pair."""
    k = np.flatnonzero(g.team[g.s] < 2)
    k = k[np.lexsort((g.s[k], g.frame[k], g.team[g.s[k]], g.m[g.s[k]]))]
    lo, hi = runs(g.m[g.s[k]], g.team[g.s[k]], g.frame[k])
    past = np.repeat(hi, hi - lo)
    a, b, at = [], [], np.arange(len(k))
    for step in range(1, int((hi - lo).max(initial=0))):
        i = np.flatnonzero(at + step < past)
        p, q = k[i], k[i + step]
        u, v = g.s[p], g.s[q]
        fits = (g.track[u] != g.track[v]) & (np.minimum(g.end[u], g.end[v]) - np.maximum(g.start[u], g.start[v]) >= overlap_s)
        a.append(p[fits])
        b.append(q[fits])
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
    order = np.lexsort((g.frame[a], g.s[a] * len(g.m) + g.s[b]))
    a, b = a[order], b[order]
    lo, hi = runs(g.s[a], g.s[b])
    of = np.repeat(np.arange(len(lo)), hi - lo)
    u, v = g.s[a[lo]], g.s[b[lo]]
    t = g.t[a]
    by_time = np.arange(len(a)) if (np.diff(t)[of[1:] == of[:-1]] >= 0).all() else np.lexsort((t, of))
    return SimpleNamespace(a=a, b=b, of=of, t=t, by_time=by_time, sorted_t=t[by_time], dy=g.y[a] - g.y[b], first=lo, past=hi, lo=lo[of], hi=hi[of], u=u, v=v, shared=np.minimum(g.end[u], g.end[v]) - np.maximum(g.start[u], g.start[v]))


def _framed(g: SimpleNamespace, p: SimpleNamespace, k: np.ndarray, t0: np.ndarray, t1: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last frame of a pair within [t0, t1], else those of the samples ``first`` and ``last``."""
    i, j = bound(p.lo[k], p.hi[k], lambda q: p.sorted_t[q] < t0), bound(p.lo[k], p.hi[k], lambda q: p.sorted_t[q] <= t1)
    of, q = spread(i, j)
    frame, least, most = g.frame[p.a[p.by_time[q]]], np.full(len(k), np.iinfo(np.int64).max), np.full(len(k), np.iinfo(np.int64).min)
    np.minimum.at(least, of, frame)
    np.maximum.at(most, of, frame)
    return np.where(i < j, least, g.frame[p.a[first]]), np.where(i < j, most, g.frame[p.a[last]])


def swaps(r: SimpleNamespace, g: SimpleNamespace, c: SimpleNamespace, p: SimpleNamespace, moved: float = 1.0, rearm_s: float = 1.0) -> Iterator[dict]:
    """As ``plays.detect_swaps``."""
    k = 1 + np.flatnonzero((p.of[1:] == p.of[:-1]) & (p.dy[:-1] * p.dy[1:] < 0))
    dx = g.x[p.a[k]] - g.x[p.b[k]]
    distance = np.sqrt(dx * dx + p.dy[k] * p.dy[k])
    fits = (np.maximum(g.v[p.a[k]], g.v[p.b[k]]) >= 1.0) & (distance <= 4.0)
    k, distance = k[fits], distance[fits]
    cross = (p.t[k - 1] + p.t[k]) / 2

    def apart(first: np.ndarray, past: np.ndarray, side: np.ndarray) -> np.ndarray:
        of, q = spread(first, past)
        q = p.by_time[q]
        same, most = p.dy[q] * side[of] > 0, np.zeros(len(k))
        np.maximum.at(most, of[same], np.abs(p.dy[q[same]]))
        return most

    till = lambda test: bound(p.lo[k], p.hi[k], test)
    before = apart(till(lambda q: p.sorted_t[q] < cross - 2.0), till(lambda q: p.sorted_t[q] < cross), p.dy[k - 1])
    after = apart(till(lambda q: p.sorted_t[q] <= cross), till(lambda q: p.sorted_t[q] <= cross + 2.0), p.dy[k])
    fits = (before >= 1.5) & (after >= 1.5)
    k, distance, cross, before, after = (v[fits] for v in (k, distance, cross, before, after))

    a, b = p.a[k], p.b[k]
    m, team = g.m[g.s[a]], g.team[g.s[a]]
    held = context_at(c, m, cross)
    goal = np.where(g.x[a] + g.x[b] < 40, 0.0, 40.0)
    goal[held >= 0] = c.goal[held[held >= 0]]
    da, db = goal_far(g.x[a], g.y[a], goal), goal_far(g.x[b], g.y[b], goal)
    fits = (np.minimum(da, db) >= 4) & (np.maximum(da, db) <= 17)
    fits[held >= 0] &= c.team[held[held >= 0]] == team[held >= 0]
    alone = np.flatnonzero(fits & (held < 0))
    if len(alone):
        own = np.flatnonzero(r.team < 2)
        frames = int(max(r.frame.max(), g.frame.max())) + 1
        key = (r.m[own] * frames + r.frame[own]) * 2 + r.team[own]
        order = np.argsort(key, kind="stable")
        asked = (m[alone] * frames + g.frame[a[alone]]) * 2 + 1 - team[alone]
        of, q = spread(*(np.searchsorted(key[order], asked, side) for side in ("left", "right")))
        q = own[order[q]]
        closer = goal_far(r.x[q], r.y[q], goal[alone][of]) < np.minimum(da, db)[alone][of]
        fits[alone] = np.bincount(of[closer], minlength=len(alone)) >= 2
    t0 = np.maximum(np.minimum(g.begun[a], g.begun[b]), cross - 3.5)
    t1 = np.minimum(np.maximum(g.ended[a], g.ended[b]), cross + 3.5)
    for x in (a, b):
        i, j = sample_at(g, g.s[x], t0), sample_at(g, g.s[x], t1)
        ex, ey = g.x[j] - g.x[i], g.y[j] - g.y[i]
        fits &= np.sqrt(ex * ex + ey * ey) >= moved
    k, distance, cross, before, after, a, b, goal, t0, t1 = (v[fits] for v in (k, distance, cross, before, after, a, b, goal, t0, t1))
    free = np.lexsort((cross, p.t[k], p.of[k]))
    free = free[taken(p.of[k[free]], p.t[k[free]], cross[free] + rearm_s)]
    k, distance, cross, before, after, a, b, goal, t0, t1 = (v[free] for v in (k, distance, cross, before, after, a, b, goal, t0, t1))
    scissors = (np.minimum(g.v[a], g.v[b]) >= 1.2) & (g.vy[a] * g.vy[b] < 0) & (distance <= 2.5)
    sure = 0.45 + 0.2 * np.minimum(1.0, np.maximum(g.v[a], g.v[b]) / 3) + 0.15 * np.minimum(1.0, np.minimum(before, after) / 3) + np.where(scissors, 0.15, 0.0)
    yield from _events(
        g, 0, Y.SWAP, (g.s[a], g.s[b]), *_framed(g, p, k, t0, t1, k, k), t0, t1, np.minimum(0.95, sure), goal,
        [Y.SCISSORS if x else Y.SEQUENTIAL for x in scissors.tolist()], {"cross_time_s": cross, "pair_distance_m": distance},
    )


def run_ins(g: SimpleNamespace) -> Iterator[dict]:
    """As ``plays.detect_run_ins``."""
    i, end, far, near, sure = run_ins_taken(g.t, g.goal, g.d, g.s, g.hi)
    yield from _events(g, 1, Y.RUN_IN, (g.s[i],), g.begun_frame[i], g.frame[end], g.begun[i], g.t[end], sure, g.goal[i], None, {"start_dist_m": far, "end_dist_m": near})


def pushes(g: SimpleNamespace, p: SimpleNamespace) -> Iterator[dict]:
    """As ``plays.detect_pushes``."""
    most = lambda v: np.maximum.reduceat(v, p.first) if len(p.first) else np.empty(0)
    v = g.v[p.a], g.v[p.b]
    able = (p.shared >= 1.0) & (p.past - p.first >= 5) & (most(v[0]) >= 1.2) & (most(v[1]) >= 1.2)
    goal, side, wide = g.goal[p.a], g.side[p.a], np.abs(p.dy)
    d = np.stack([g.d[:, p.a], g.d[:, p.b]])
    own = np.where(side == 0, d[:, 0], d[:, 1])
    start = able[p.of] & ~np.isnan(goal) & (own.min(axis=0) >= 7) & (own.max(axis=0) <= 17) & (wide >= 1.5) & (wide <= 8)
    k, last, gain, pace = pushes_taken(p.t, p.dy, side, start, d, v, p.of, p.lo, p.hi)
    a, b = p.a[last], p.b[last]
    t0 = np.maximum(np.minimum(g.begun[a], g.begun[b]), p.t[k] - 3.0)
    t1 = np.minimum(np.maximum(g.ended[a], g.ended[b]), p.t[last] + 3.0)
    sure = np.minimum(0.95, 0.45 + 0.2 * np.minimum(1.0, gain / 4) + 0.15 * np.minimum(1.0, pace / 3))
    yield from _events(g, 2, Y.PUSH, (g.s[a], g.s[b]), *_framed(g, p, k, t0, t1, k, last), t0, t1, sure, goal[k], None, {"approach_m": gain})


def series_of(r: SimpleNamespace) -> SimpleNamespace:
    """As ``plays.centroid_series``, in order of match, team and frame."""
    k = np.flatnonzero(r.team < 2)
    k = k[np.lexsort((r.t[k], r.frame[k], r.team[k], r.m[k]))]
    lo, hi = runs(r.m[k], r.team[k], r.frame[k], r.t[k])
    x = (np.add.reduceat(r.x[k], lo) if len(lo) else np.empty(0)) / (hi - lo)
    keep = hi - lo >= 3
    k, x = k[lo[keep]], x[keep]
    first, past = runs(r.m[k], r.team[k])
    keep = np.repeat(past - first >= 5, past - first)
    k, x = k[keep], x[keep]
    first, past = runs(r.m[k], r.team[k])
    n = past - first
    return SimpleNamespace(m=r.m[k], team=r.team[k], frame=r.frame[k], t=r.t[k], x=smoothed(x, np.repeat(first, n), np.repeat(past, n)), first=first, past=past)


def breaks(r: SimpleNamespace, c: SimpleNamespace, s: SimpleNamespace) -> Iterator[dict]:
    """As ``plays.detect_fast_breaks``."""
    soon = np.zeros(len(s.t), bool)
    k = np.zeros(len(s.t), np.int64)
    if len(c.m):
        k = bound(c.lo[s.m], c.hi[s.m], lambda q: c.end[q] <= s.t)
        soon = k < c.hi[s.m]
        k = np.where(soon, k, 0)
        soon &= c.start[k] <= s.t + 4.0
    free = [np.ones(len(s.t), bool), np.ones(len(s.t), bool)]
    for z, f in zip((40.0, 0.0), free, strict=True):
        f[soon] = (c.team[k[soon]] == s.team[soon]) & (c.goal[k[soon]] == z)
    i, end, sure, to, gone, pace = Y.breaks_in(s.past - s.first, s.t, s.x, *free)
    for m, team, *e in zip(*(v.tolist() for v in (s.m[i], s.team[i], s.frame[i], s.frame[end], s.t[i], s.t[end], sure, to, gone, pace)), strict=True):
        yield {"m": m, "source": 3, "play_type": Y.BREAK, "team": r.teams[team], **dict(zip(("start_frame", "end_frame", "t0", "t1", "confidence", "goal_x"), e, strict=False)), "segs": (), "series": team, "measures": {"distance_m": e[6], "mean_speed_ms": e[7]}}


def timeline(g: SimpleNamespace, c: SimpleNamespace, bin_s: float = 0.5, most: float = 8.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``plays.assign_roles``, in order of segment and time: segments, times, roles by number (-1 for none)."""
    number = g.t / bin_s - 0.5
    here = np.floor(number).astype(np.int64)
    b0 = np.ceil(number).astype(np.int64)
    b0[1:] = np.where(g.s[1:] == g.s[:-1], here[:-1] + 1, b0[1:])
    k = np.flatnonzero(g.team[g.s] < 2)
    of, b = spread(b0[k], here[k] + 1)
    k = k[of]
    t = (b + 0.5) * bin_s
    held = context_at(c, g.m[g.s[k]], t)
    own = np.flatnonzero(held >= 0)
    own = own[c.team[held[own]] == g.team[g.s[k[own]]]]
    k, t, goal = k[own], t[own], c.goal[held[own]]
    order = np.lexsort((g.s[k], t, g.m[g.s[k]]))
    k, t, goal = k[order], t[order], goal[order]
    places = np.array([[Y.role_slot(x, z) for x in ROLES] for z in (0.0, 40.0)])[(goal == 40).astype(np.int64)]
    dx, dy = g.x[k, None] - places[:, :, 0], g.y[k, None] - places[:, :, 1]
    costs, role = np.sqrt(dx * dx + dy * dy), np.full(len(k), -1)
    lo, hi = runs(g.m[g.s[k]], t)
    for n in np.unique(hi - lo).tolist():
        at = lo[hi - lo == n][:, None] + np.arange(n)
        role[at] = Y.slots_of_least_total(costs[at])
    role[(role >= 0) & ~(costs[np.arange(len(k)), role] <= most)] = -1
    order = np.lexsort((t, g.s[k]))
    return g.s[k][order], t[order], role[order]


def transitions_of(g: SimpleNamespace, c: SimpleNamespace) -> dict[str, np.ndarray]:
    """As ``plays.role_transitions`` of ``plays.stable_runs``: segment, roles by number, times."""
    s, t, role = timeline(g, c)
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (role[1:] != role[:-1]) | (np.diff(t) > 1.5)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(s))[: len(lo)] - 1
    keep = (role[lo] >= 0) & (t[hi] - t[lo] >= 0.9)
    lo, hi = lo[keep], hi[keep]
    a, b = slice(None, -1), slice(1, None)
    k = np.flatnonzero((s[lo][a] == s[lo][b]) & (role[lo][a] != role[lo][b]) & (t[lo][b] - t[hi][a] <= 3.0))
    return {"s": s[lo][k], "source": role[lo][k], "to": role[lo][k + 1], "left": t[hi][k], "settled": t[lo][k + 1], "until": t[hi][k + 1]}


def role_swaps(g: SimpleNamespace, moves: dict[str, np.ndarray]) -> Iterator[dict]:
    """As ``plays.detect_role_swaps``."""
    back = (moves["source"] != PIVOT) & (moves["to"] != PIVOT)
    s, source, to, left, settled = (moves[k][back] for k in ("s", "source", "to", "left", "settled"))
    r0, r1 = np.minimum(source, to), np.maximum(source, to)
    order = np.lexsort((left, s, r1, r0, g.team[s], g.m[s]))
    s, source, to, left, settled, r0, r1 = (v[order] for v in (s, source, to, left, settled, r0, r1))
    found = []
    for lo, hi in zip(*(v.tolist() for v in runs(g.m[s], g.team[s], r0, r1)), strict=True):
        if hi - lo > 1:
            part = slice(lo, hi)
            found += [(lo + i, lo + j, sure) for i, j, sure in Y.exchanged(s[part].tolist(), source[part].tolist(), to[part].tolist(), left[part].tolist(), settled[part].tolist())]
    i, j, sure = (np.array([x[k] for x in found], kind) for k, kind in enumerate((np.int64, np.int64, float)))
    t0 = np.minimum(*(g.begun[sample_at(g, s[k], left[k])] for k in (i, j)))
    t1 = np.maximum(*(g.ended[sample_at(g, s[k], settled[k])] for k in (i, j)))
    roles = [[(t, ROLES[a], ROLES[b]), (u, ROLES[b], ROLES[a])] for t, u, a, b in zip(*(v.tolist() for v in (g.track[s[i]], g.track[s[j]], source[i], to[i])), strict=True)]
    frames = (g.frame[sample_at(g, s[i], t)] for t in (t0, t1))
    yield from _events(g, 4, Y.SWAP, (s[i], s[j]), *frames, t0, t1, sure, None, ["rollentausch"] * len(i), None, roles)


def role_runins(g: SimpleNamespace, moves: dict[str, np.ndarray], hold_s: float = 1.2) -> Iterator[dict]:
    """As ``plays.detect_role_runins``."""
    k = (moves["source"] != PIVOT) & (moves["to"] == PIVOT) & (moves["until"] - moves["settled"] >= hold_s)
    s, source, to, left, settled = (moves[c][k] for c in ("s", "source", "to", "left", "settled"))
    t0 = g.begun[sample_at(g, s, left)]
    t1 = np.maximum(g.ended[sample_at(g, s, settled)], np.minimum(settled + 1.0, g.end[s]))
    roles = [[(t, ROLES[a], ROLES[b])] for t, a, b in zip(g.track[s].tolist(), source.tolist(), to.tolist(), strict=True)]
    frames = (g.frame[sample_at(g, s, t)] for t in (t0, t1))
    yield from _events(g, 5, Y.RUN_IN, (s,), *frames, t0, t1, np.full(len(s), 0.65), None, ["rollenwechsel"] * len(s), None, roles)


def _events(g, source, play_type, segs, start, end, t0, t1, sure, goal, variant, measures, roles=None) -> Iterator[dict]:  # noqa: ANN001, PLR0913
    """Events from arrays; ``segs`` holds an array for each segment that takes part."""
    n = range(len(t0))
    ids = list(zip(*(s.tolist() for s in segs), strict=True))
    m, team, numbers, tracks = g.m[segs[0]].tolist(), g.team[segs[0]].tolist(), g.id.tolist(), g.track.tolist()
    cols = [v.tolist() for v in (start, end, t0, t1, sure)]
    goal = [None] * len(n) if goal is None else goal.tolist()
    measures = {k: v.tolist() for k, v in measures.items()} if measures else None
    for k in n:
        yield {
            "m": m[k], "source": source, "play_type": play_type, "team": g.teams[team[k]], "start_frame": cols[0][k], "end_frame": cols[1][k], "t0": cols[2][k], "t1": cols[3][k], "confidence": cols[4][k],
            "goal_x": goal[k], "variant": variant[k] if variant else None, "measures": {c: v[k] for c, v in measures.items()} if measures else None, "roles": roles[k] if roles else None,
            "segs": ids[k], "seg_ids": [numbers[s] for s in ids[k]], "track_ids": [tracks[s] for s in ids[k]],
        }


def _line(t: np.ndarray, x: np.ndarray, y: np.ndarray, most: int = 25) -> list[list[float]]:
    """As ``segments.trajectories``."""
    ps = sorted(_hundredths(t, x, y).tolist())
    n = len(ps)
    return [ps[k] for k in np.round(np.arange(most) * (n - 1) / (most - 1)).astype(int).tolist()] if n > most else ps


def _hundredths(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.floor(np.stack([t, x, y], axis=1) * 100 + 0.5) / 100.0


def _lines(g: SimpleNamespace, seg: np.ndarray, t0: np.ndarray, t1: np.ndarray, most: int = 25) -> list[list[list[float]]]:
    """The line of each segment in its span."""
    ps = _hundredths(g.t, g.x, g.y)
    if not (np.diff(ps[:, 0])[g.s[1:] == g.s[:-1]] > 0).all():  # points of one hundredth go by their place
        inside = [g.first[k] + np.flatnonzero((g.t[g.first[k] : g.past[k]] >= a) & (g.t[g.first[k] : g.past[k]] <= z)) for k, a, z in zip(seg.tolist(), t0.tolist(), t1.tolist(), strict=True)]
        return [_line(g.t[k], g.x[k], g.y[k], most) for k in inside]
    lo, hi = bound(g.first[seg], g.past[seg], lambda q: g.t[q] < t0), bound(g.first[seg], g.past[seg], lambda q: g.t[q] <= t1)
    n = np.maximum(hi - lo, 0)
    of, k = spread(np.zeros(len(n), np.int64), np.minimum(n, most))
    k = lo[of] + np.where(n[of] > most, np.round(k * (n[of] - 1) / (most - 1)).astype(np.int64), k)
    points, ends = ps[k].tolist(), np.cumsum(np.minimum(n, most)).tolist()
    return [points[a:z] for a, z in zip([0, *ends], ends, strict=False)]


def _tracks(found: list[dict], g: SimpleNamespace, s: SimpleNamespace) -> Iterator[list[tuple] | None]:
    """What each segment of an event did in its time; the team's centroid, at half width, where none takes part."""
    asked = [(k, e["t0"], e["t1"]) for e in found for k in e["segs"]]
    seg, t0, t1 = (np.array([a[i] for a in asked], kind) for i, kind in enumerate((np.int64, float, float)))
    lines = iter(zip(g.track[seg].tolist(), _lines(g, seg, t0, t1), strict=True))
    whole = {(m, team): slice(a, z) for m, team, a, z in zip(s.m[s.first].tolist(), s.team[s.first].tolist(), s.first.tolist(), s.past.tolist(), strict=True)}
    for e in found:
        if e["segs"]:
            yield [x for x in islice(lines, len(e["segs"])) if x[1]] or None
        else:
            own = whole[e["m"], e["series"]]
            inside = (s.t[own] >= e["t0"]) & (s.t[own] <= e["t1"])
            yield [(-1, _line(s.t[own][inside], s.x[own][inside], np.full(inside.sum(), 10.0)))]


def _context_rows(r: SimpleNamespace, c: SimpleNamespace) -> Iterator[dict]:
    """Contexts with the first frame at or after their start and end, else the match's last."""
    order = np.lexsort((r.frame, r.t, r.m))
    t, frame = r.t[order], r.frame[order]
    edge = np.searchsorted(r.m[order], np.arange(len(r.ids) + 1))
    lo, hi = edge[:-1][c.m], edge[1:][c.m]
    frames = []
    last = np.maximum.reduceat(frame, edge[:-1])[c.m] if len(c.m) else np.empty(0, np.int64)
    for at in (c.start, c.end):
        k = bound(lo, hi, lambda q, at=at: t[q] < at)
        frames.append(np.where(k < hi, frame[np.minimum(k, len(frame) - 1)], last).tolist())
    for m, goal, team, start, end, f0, f1 in zip(*(v.tolist() for v in (c.m, c.goal, c.team, c.start, c.end)), *frames, strict=True):
        yield {"m": m, "source": -1, "team": r.teams[team], "goal_x": goal, "t0": start, "t1": end, "start_frame": f0, "end_frame": f1}


def plays_of(r: SimpleNamespace, what: tuple[str, ...], whole: bool) -> Iterator[dict]:
    """Events of the detectors in ``what``; with contexts and tracks, if ``whole``."""
    if not len(r.t):
        return
    want = set(what)
    c = contexts_of(r)
    g = segments_of(r) if want - {"breaks"} else None
    s = series_of(r) if "breaks" in want else None
    found = []
    if want & {"run_ins", "pushes"}:
        _attacks(g, c)
    if want & {"swaps", "pushes"}:
        p = pairs_of(g)
        found += [*(swaps(r, g, c, p) if "swaps" in want else ()), *(pushes(g, p) if "pushes" in want else ())]
    if "run_ins" in want:
        found += run_ins(g)
    if "breaks" in want:
        found += breaks(r, c, s)
    if want & {"role_swaps", "role_runins"}:
        moves = transitions_of(g, c)
        found += [*(role_swaps(g, moves) if "role_swaps" in want else ()), *(role_runins(g, moves) if "role_runins" in want else ())]
    if whole:
        yield from _context_rows(r, c)
    for e, tracks in zip(found, _tracks(found, g, s) if whole else repeat(None)):  # noqa: B905
        yield e | {"tracks": tracks}


def scan(matches: DataFrame, what: tuple[str, ...] = DETECTORS, unpack: Callable[[pa.RecordBatch], SimpleNamespace] = match_rows, whole: bool = False) -> DataFrame:
    """Plays of matches, which come as one row each (``packed``, or what ``unpack`` turns into rows): ``plays.EVENT``
    with the detector's number as ``source``; with contexts, as source -1, and tracks, if ``whole``."""
    schema = StructType.fromDDL(FOUND)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(size):
                past = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
                part = unpack(batch.slice(at, past - at))
                yield _as_arrow(part.ids, plays_of(part, what, whole), arrow)
                at = past

    return matches.mapInArrow(run, schema)


def _as_arrow(ids: pa.Array, events: Iterator[dict], schema: pa.Schema) -> pa.RecordBatch:
    held = list(events)
    out = []
    for f in schema:
        if f.name == "match_id":
            out.append(ids.take(pa.array([e["m"] for e in held], pa.int64())).cast(f.type))
            continue
        v = [e.get(f.name) for e in held]
        if f.name in ("seg_ids", "track_ids"):
            v = [x or [] for x in v]
        elif f.name == "measures":
            v = [None if x is None else list(x.items()) for x in v]
        elif f.name in ("roles", "tracks"):
            names = ("track_id", "from_role", "to_role") if f.name == "roles" else ("track_id", "points")
            v = [None if x is None else [dict(zip(names, y, strict=True)) for y in x] for x in v]
        out.append(pa.array(v, f.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)
