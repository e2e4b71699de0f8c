"""SQL that scores the stored forests: the independent side of the model keys.

A recursive query descends the node table (view ``nodes``: candidate, tree, node,
feature, threshold, left_child, right_child, weight, gain, share) for every row
and tree.  The feature tables are re-derived from the raw rows by ``sqlparts``.
"""

from __future__ import annotations

from . import sqlparts as S

#: Number of the selected forest in the node table.
SELECTED = -1
X = ("latency", "throughput", "packet_loss")
_MD5 = "md5(concat_ws(':', '{seed}', l_orderkey, l_linenumber, l_partkey, l_suppkey))"


def unit(seed: int) -> str:
    """The row's number in [0, 1) that splits are made by."""
    return f"(CAST(('0x' || substr({_MD5.format(seed=seed)}, 1, 8)) AS BIGINT) / 4294967296.0)"


def model_rows(name: str, where: str = "true") -> str:
    """Rows of ``feat`` in the model's ranges (``sqlparts.ORDER`` is their key)."""
    return (
        f"{name} AS (SELECT {S.ORDER}, congestion, least(greatest(latency, 0), 5000) AS latency, least(greatest(throughput, 0), 1) AS throughput, "
        f"least(greatest(packet_loss, 0), 1) AS packet_loss FROM feat WHERE {where})"
    )


def descend(name: str, src: str, keys: str, candidate: int = SELECTED) -> str:
    """CTEs ``{name}_walk`` and ``{name}``: (keys, prob) of every row of ``src``."""
    own = ", ".join(f"w.{k.strip()}" for k in keys.split(","))
    x, wx = ", ".join(X), ", ".join(f"w.{c}" for c in X)
    at = "n.tree, n.feature, n.threshold, n.left_child, n.right_child, n.share"
    value = "CASE w.feature WHEN 0 THEN w.latency WHEN 1 THEN w.throughput ELSE w.packet_loss END"
    return f"""{name}_walk AS (
  SELECT {keys}, {x}, {at} FROM {src}, nodes n WHERE n.node = 0 AND n.candidate = {candidate}
  UNION ALL
  SELECT {own}, {wx}, {at} FROM {name}_walk w JOIN nodes n
    ON n.candidate = {candidate} AND n.tree = w.tree AND n.node = CASE WHEN {value} <= w.threshold THEN w.left_child ELSE w.right_child END
  WHERE w.feature IS NOT NULL),
{name} AS (SELECT {keys}, avg(share) AS prob FROM {name}_walk WHERE feature IS NULL GROUP BY {keys})"""


def query(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([*S.FEAT_CTES, *parts]) + "\n" + select


def metrics(src: str, threshold: float = 0.5) -> str:
    """Confusion cells and rates of (congestion, prob) rows."""
    p = f"prob > {threshold}"
    cells = ", ".join(f"count(*) FILTER (WHERE congestion = {y} AND {'' if g else 'NOT '}({p})) AS {n}" for n, y, g in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))
    rate = lambda a, b, n: f"coalesce(({a}) / nullif(CAST({b} AS DOUBLE), 0), 0) AS {n}"
    return (
        f"SELECT tp, fp, fn, tn, {rate('tp + tn', 'tp + tn + fp + fn', 'accuracy')}, {rate('tp', 'tp + fp', 'precision')}, "
        f"{rate('tp', 'tp + fn', 'recall')}, {rate('2 * tp', '2 * tp + fp + fn', 'f1')} FROM (SELECT {cells} FROM {src})"
    )


def importance(candidate: int = SELECTED) -> str:
    """(feature, importance): gain times weight, scaled per tree, then over trees."""
    return f"""SELECT feature, g / sum(g) OVER () AS importance FROM (
  SELECT feature, sum(s / t) AS g FROM (
    SELECT tree, feature, sum(gain * weight) AS s, sum(sum(gain * weight)) OVER (PARTITION BY tree) AS t
    FROM nodes WHERE feature IS NOT NULL AND candidate = {candidate} GROUP BY tree, feature) WHERE t > 0 GROUP BY feature)"""
