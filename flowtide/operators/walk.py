"""The steps of a what-if policy over Arrow batches.

The same rules as the column expressions of ``whatif.py`` (its actions, effects and
rewards), step by step on arrays of states.  A projection of many chained steps is too
large for Spark's generated code: it falls back to one small projection after the other,
each of which copies the row.  Missing values are NaN here; a comparison with one is
false, as it is not true in SQL, and ``fmax``/``fmin`` skip it like greatest/least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions import constants as K

CODE = {a: i for i, a in enumerate(K.ACTIONS)}
IDLE = CODE["do_nothing"]
_EFFECT = [np.array([1.0 if K.ACTION_EFFECTS[a][i] is None else K.ACTION_EFFECTS[a][i] for a in K.ACTIONS]) for i in range(3)]
State = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def probability(lat: np.ndarray, loss: np.ndarray, mbps: np.ndarray) -> np.ndarray:
    w_lat, w_loss, w_bw = K.HEURISTIC_WEIGHTS
    return np.clip((lat / K.LATENCY_MAX) * w_lat + loss * w_loss + (1.0 - np.fmin(mbps / K.MBPS_MAX, 1.0)) * w_bw, 0.0, 1.0)


def after(code: np.ndarray | int, state: State) -> State:
    lat, tp, loss, load = state
    b = K.STATE_BOUNDS
    less = np.fmax(load * K.ACTION_EFFECTS["rebalance_towers"][3], K.REBALANCE_FLOOR)
    load = np.where(np.equal(code, CODE["rebalance_towers"]), less, load)
    moved = [np.clip(v * _EFFECT[i][code], *b[n]) for i, (v, n) in enumerate(zip((lat, tp, loss), ("latency", "throughput", "packet_loss")))]
    return (*moved, np.clip(load, *b["tower_load"]))


def reward(code: np.ndarray | int, p_old: np.ndarray, p_new: np.ndarray, old: State, new: State) -> np.ndarray:
    idle = np.equal(code, IDLE)
    base = np.where(idle & (p_new <= K.IDLE_BELOW), K.REWARD_IDLE_OK, np.where(p_new < p_old, (p_old - p_new) * K.REWARD_GAIN_SCALE, K.REWARD_NO_GAIN))
    base = base + np.where(new[0] < old[0], K.REWARD_LATENCY_BETTER, 0.0)
    base = base + np.where(new[1] > old[1], K.REWARD_MBPS_BETTER, 0.0)
    return base + np.where(idle & (p_new > K.IDLE_BELOW), K.REWARD_IDLE_BAD, 0.0)


class Priority:
    """The first wanted action that was not taken in the last two steps, else the one whose turn it is."""

    def __init__(self, n: int):
        self.one_ago, self.two_ago, self.steps = np.full(n, -1), np.full(n, -1), np.zeros(n, int)

    def __call__(self, state: State, p: np.ndarray) -> np.ndarray:
        lat, tp, loss, load = state
        wants = [
            (CODE["reduce_load"], loss > K.PRIORITY_LOSS_ABOVE),
            (CODE["reroute_traffic"], lat > K.PRIORITY_LATENCY_ABOVE),
            (CODE["increase_bandwidth"], tp < K.PRIORITY_MBPS_BELOW),
            (CODE["rebalance_towers"], load > K.PRIORITY_LOAD_ABOVE),
        ]
        size = sum(w.astype(int) for _, w in wants)
        none = size == 0
        size = np.where(none, len(K.PRIORITY_FALLBACK), size)
        turn, place = self.steps % size, np.zeros(len(p), int)
        fresh, due = np.full(len(p), -1), np.full(len(p), -1)
        for code, want in [*wants, *((CODE[a], none) for a in K.PRIORITY_FALLBACK)]:
            recent = (self.steps >= 2) & ((self.one_ago == code) | (self.two_ago == code))
            fresh = np.where((fresh < 0) & want & ~recent, code, fresh)
            due = np.where((due < 0) & want & (turn == place), code, due)
            place = place + want
        idle = p < K.IDLE_BELOW
        act = np.where(idle, IDLE, np.where(fresh >= 0, fresh, due))
        self.two_ago = np.where(idle, -1, self.one_ago)
        self.one_ago = np.where(idle, -1, act)
        self.steps = np.where(idle, 0, np.minimum(self.steps + 1, K.HISTORY_CAP))
        return act


def greedy(state: State, p: np.ndarray) -> np.ndarray:
    best, act = None, None
    for code in range(len(K.ACTIONS)):
        new = after(code, state)
        r = reward(code, p, probability(new[0], new[2], new[1]), state, new)
        better = np.ones(len(p), bool) if best is None else r > best
        best, act = (r, np.full(len(p), code)) if best is None else (np.where(better, r, best), np.where(better, code, act))
    return act


def rule(state: State, p: np.ndarray) -> np.ndarray:
    lat, tp, loss, load = state
    steps = [
        ((load >= K.RULE_LOAD_AT_LEAST) | (p >= K.RULE_PROB_AT_LEAST), "rebalance_towers"),
        (loss >= K.RULE_LOSS_AT_LEAST, "reduce_load"),
        (tp <= K.RULE_MBPS_AT_MOST, "increase_bandwidth"),
        (lat >= K.RULE_LATENCY_AT_LEAST, "reroute_traffic"),
    ]
    return np.select([c for c, _ in steps], [CODE[a] for _, a in steps], IDLE)


def walk(policy: str, steps: int, state: State, p: np.ndarray, drawn: np.ndarray | None = None) -> Iterator[tuple]:
    """(action codes, state, probability, reward) of every step; ``drawn`` has the codes of the random policy."""
    priority = Priority(len(p))
    for s in range(steps):
        if policy == "priority":
            code = priority(state, p)
        elif policy == "greedy":
            code = greedy(state, p)
        elif policy == "random":
            code = drawn[:, s]
        elif policy == "rule":
            code = rule(state, p)
        else:
            code = np.full(len(p), IDLE)
        new = after(code, state)
        p_new = probability(new[0], new[2], new[1])
        r = reward(code, p, p_new, state, new)
        state, p = new, p_new
        yield code, state, p, r


def _numbers(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), mask=np.isnan(x))


def _names(code: np.ndarray) -> pa.Array:
    return pa.array(K.ACTIONS).take(pa.array(code))


def _input(columns: tuple, steps: int) -> tuple[State, np.ndarray, np.ndarray | None]:
    x = [c.to_numpy(zero_copy_only=False).astype(float) for c in columns[:5]]
    drawn = columns[5].flatten().to_numpy(zero_copy_only=False).reshape(-1, steps) if len(columns) > 5 else None
    return tuple(x[:4]), x[4], drawn


FINAL = ["latency", "throughput", "packet_loss", "tower_load", "prob", "total_reward"]


def finals(policy: str, steps: int):
    def run(*columns: pa.Array) -> pa.Array:
        state, p, drawn = _input(columns, steps)
        total = np.zeros(len(p))
        for _, state, p, r in walk(policy, steps, state, p, drawn):
            total = total + r
        return pa.StructArray.from_arrays([_numbers(v) for v in (*state, p, total)], names=FINAL)

    return run


def _rows(values: pa.Array, n: int, steps: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * steps), values)


def actions(policy: str, steps: int):
    def run(*columns: pa.Array) -> pa.Array:
        state, p, drawn = _input(columns, steps)
        codes = [code for code, *_ in walk(policy, steps, state, p, drawn)]
        return _rows(_names(np.stack(codes, axis=1).ravel()) if codes else pa.array([], pa.string()), len(p), steps)

    return run


def log(policy: str, steps: int, fields: list[str]):
    """Every step's entry: number, action, the state after it, its reward and the state before."""

    def run(*columns: pa.Array) -> pa.Array:
        state, p, drawn = _input(columns, steps)
        start, n, taken = (*state, p), len(p), list(walk(policy, steps, state, p, drawn))
        flat = lambda each: np.stack(each, axis=1).ravel()
        states = [start, *((*s, q) for _, s, q, _ in taken)]
        values = [
            pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), n)),
            _names(flat([t[0] for t in taken])),
            *[_numbers(flat([s[i] for s in states[1:]])) for i in range(5)],
            _numbers(flat([t[3] for t in taken])),
            *[_numbers(flat([s[i] for s in states[:-1]])) for i in range(5)],
        ]
        return _rows(pa.StructArray.from_arrays(values, names=fields), n, steps)

    return run
