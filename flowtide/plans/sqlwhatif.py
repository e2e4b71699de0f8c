"""SQL text for the what-if projections (oracle side): one CTE chain per policy.

The chain is plain SQL generated step by step: state columns ``lat, tp, loss,
load, prob`` are rewritten by every step and the step values are kept as
``a{i}`` (action), ``la{i}`` ... (after) and ``lb{i}`` ... (before) columns.
"""

from __future__ import annotations

from ..functions import constants as K
from .sqlparts import heuristic

AFTER = [("la", "lat"), ("ta", "tp"), ("sa", "loss"), ("oa", "load"), ("pa", "prob")]
BEFORE = [("lb", "lat"), ("tb", "tp"), ("sb", "loss"), ("ob", "load"), ("pb", "prob")]


def _factor(act: str, idx: int) -> str:
    whens = " ".join(f"WHEN {act} = '{a}' THEN {eff[idx]!r}" for a, eff in K.ACTION_EFFECTS.items() if eff[idx] is not None)
    return f"CAST(CASE {whens} ELSE 1.0 END AS DOUBLE)"


def _effects(act: str) -> dict[str, str]:
    b = K.STATE_BOUNDS
    return {
        "lat": f"least(greatest(lat * {_factor(act, 0)}, {b['latency'][0]}), {b['latency'][1]})",
        "tp": f"least(greatest(tp * {_factor(act, 1)}, {b['throughput'][0]}), {b['throughput'][1]})",
        "loss": f"least(greatest(loss * {_factor(act, 2)}, {b['packet_loss'][0]}), {b['packet_loss'][1]})",
        "load": f"least(greatest(CASE WHEN {act} = 'rebalance_towers' THEN greatest(load * 0.675, {K.REBALANCE_FLOOR}) ELSE load END, "
        f"{b['tower_load'][0]}), {b['tower_load'][1]})",
    }


def _reward(act, p_old, p_new, lat_old, lat_new, tp_old, tp_new) -> str:
    idle = f"{act} = 'do_nothing'"
    return (
        f"(CASE WHEN {idle} AND {p_new} <= {K.IDLE_BELOW} THEN {K.REWARD_IDLE_OK} WHEN {p_new} < {p_old} THEN ({p_old} - {p_new}) * {K.REWARD_GAIN_SCALE} "
        f"ELSE {K.REWARD_NO_GAIN} END + CASE WHEN {lat_new} < {lat_old} THEN {K.REWARD_LATENCY_BETTER} ELSE 0.0 END "
        f"+ CASE WHEN {tp_new} > {tp_old} THEN {K.REWARD_MBPS_BETTER} ELSE 0.0 END "
        f"+ CASE WHEN {idle} AND {p_new} > {K.IDLE_BELOW} THEN {K.REWARD_IDLE_BAD} ELSE 0.0 END)"
    )


def _prios() -> str:
    found = (
        f"list_filter([CASE WHEN loss > {K.PRIORITY_LOSS_ABOVE} THEN 'reduce_load' END, CASE WHEN lat > {K.PRIORITY_LATENCY_ABOVE} THEN 'reroute_traffic' END, "
        f"CASE WHEN tp < {K.PRIORITY_MBPS_BELOW} THEN 'increase_bandwidth' END, CASE WHEN load > {K.PRIORITY_LOAD_ABOVE} THEN 'rebalance_towers' END], lambda x: x IS NOT NULL)"
    )
    fb = "[" + ", ".join(f"'{a}'" for a in K.PRIORITY_FALLBACK) + "]"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE {fb} END"


def rule_sql() -> str:
    return (
        f"CASE WHEN load >= {K.RULE_LOAD_AT_LEAST} OR prob >= {K.RULE_PROB_AT_LEAST} THEN 'rebalance_towers' "
        f"WHEN loss >= {K.RULE_LOSS_AT_LEAST} THEN 'reduce_load' WHEN tp <= {K.RULE_MBPS_AT_MOST} THEN 'increase_bandwidth' "
        f"WHEN lat >= {K.RULE_LATENCY_AT_LEAST} THEN 'reroute_traffic' ELSE 'do_nothing' END"
    )


def greedy_sql() -> tuple[str, str]:
    """(select list adding r0..r4, action expression)."""
    rs = []
    for i, a in enumerate(K.ACTIONS):
        e = _effects(f"'{a}'")
        p = heuristic(e["lat"], e["loss"], e["tp"])
        rs.append(f"{_reward(repr(a), 'prob', p, 'lat', e['lat'], 'tp', e['tp'])} AS r{i}")
    best = "greatest(" + ", ".join(f"r{i}" for i in range(len(K.ACTIONS))) + ")"
    act = "CASE " + " ".join(f"WHEN r{i} = {best} THEN '{a}'" for i, a in enumerate(K.ACTIONS)) + " END"
    return ", ".join(rs), act


def random_sql(step: int, keys: str, seed: int = 42) -> str:
    arr = "[" + ", ".join(f"'{a}'" for a in K.ACTIONS) + "]"
    h = f"CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {keys}, '{step}')), 1, 8)) AS BIGINT)"
    return f"{arr}[({h} % {len(K.ACTIONS)}) + 1]"


def chain(src: str, policy: str, steps: int, keys: str, prefix: str = "w") -> tuple[list[str], str]:
    """CTEs advancing ``src`` (keys, lat, tp, loss, load, prob) by ``steps`` steps."""
    ctes = [
        f"{prefix}0 AS (SELECT *, lat AS init_lat, tp AS init_tp, loss AS init_loss, load AS init_load, prob AS init_prob, "
        f"CAST(NULL AS VARCHAR) AS h1, CAST(NULL AS VARCHAR) AS h2, 0 AS n, 0.0 AS total FROM {src})"
    ]
    prev = f"{prefix}0"
    for i in range(1, steps + 1):
        if policy == "priority":
            ctes.append(f"{prefix}a{i} AS (SELECT *, {_prios()} AS prios FROM {prev})")
            ctes.append(
                f"{prefix}b{i} AS (SELECT *, list_filter(prios, lambda a: NOT list_contains(CASE WHEN n >= 2 THEN [h1, h2] ELSE []::VARCHAR[] END, a)) AS fresh FROM {prefix}a{i})"
            )
            act = f"CASE WHEN prob < {K.IDLE_BELOW} THEN 'do_nothing' WHEN len(fresh) > 0 THEN fresh[1] ELSE prios[(n % len(prios)) + 1] END"
            ctes.append(f"{prefix}c{i} AS (SELECT * EXCLUDE (prios, fresh), {act} AS a{i} FROM {prefix}b{i})")
            hist = (
                f"CASE WHEN prob < {K.IDLE_BELOW} THEN NULL ELSE h2 END AS h1, CASE WHEN prob < {K.IDLE_BELOW} THEN NULL ELSE a{i} END AS h2, "
                f"CASE WHEN prob < {K.IDLE_BELOW} THEN 0 ELSE least(n + 1, {K.HISTORY_CAP}) END AS n"
            )
        else:
            if policy == "greedy":
                rsel, act = greedy_sql()
                ctes.append(f"{prefix}g{i} AS (SELECT *, {rsel} FROM {prev})")
                ctes.append(f"{prefix}c{i} AS (SELECT * EXCLUDE (r0, r1, r2, r3, r4), {act} AS a{i} FROM {prefix}g{i})")
            elif policy == "random":
                ctes.append(f"{prefix}c{i} AS (SELECT *, {random_sql(i, keys)} AS a{i} FROM {prev})")
            elif policy == "rule":
                ctes.append(f"{prefix}c{i} AS (SELECT *, {rule_sql()} AS a{i} FROM {prev})")
            else:
                ctes.append(f"{prefix}c{i} AS (SELECT *, 'do_nothing' AS a{i} FROM {prev})")
            hist = "h1, h2, n"
        e = _effects(f"a{i}")
        before = ", ".join(f"{c} AS {b}{i}" for b, c in BEFORE)
        ctes.append(
            f"{prefix}s{i} AS (SELECT * EXCLUDE (lat, tp, loss, load, h1, h2, n), {before}, {e['lat']} AS lat, {e['tp']} AS tp, "
            f"{e['loss']} AS loss, {e['load']} AS load, {hist} FROM {prefix}c{i})"
        )
        newp = heuristic("lat", "loss", "tp")
        ctes.append(f"{prefix}p{i} AS (SELECT * REPLACE ({newp} AS prob) FROM {prefix}s{i})")
        rw = _reward(f"a{i}", f"pb{i}", "prob", f"lb{i}", "lat", f"tb{i}", "tp")
        after = ", ".join(f"{c} AS {a}{i}" for a, c in AFTER)
        ctes.append(f"{prefix}{i} AS (SELECT * REPLACE (total + {rw} AS total), {rw} AS rw{i}, {after} FROM {prefix}p{i})")
        prev = f"{prefix}{i}"
    return ctes, prev


def actions_list(steps: int) -> str:
    return "[" + ", ".join(f"a{i}" for i in range(1, steps + 1)) + "]"


def step_rows(final: str, steps: int, keys: str) -> str:
    """UNION ALL of one row per step (the long step log)."""
    parts = []
    for i in range(1, steps + 1):
        parts.append(
            f"SELECT {keys}, {i} AS step, a{i} AS action, la{i} AS latency, ta{i} AS throughput, sa{i} AS packet_loss, oa{i} AS tower_load, "
            f"pa{i} AS congestion_prob, rw{i} AS reward, lb{i} AS latency_before, tb{i} AS throughput_before, sb{i} AS packet_loss_before, "
            f"ob{i} AS tower_load_before, pb{i} AS congestion_prob_before FROM {final}"
        )
    return "\nUNION ALL\n".join(parts)
