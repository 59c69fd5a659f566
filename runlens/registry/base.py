"""What the registered queries share: rounding, views, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Register a query and, where plain SQL can state it, its oracle."""
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Round away engine differences; the nudge settles ties, the zero clears a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + 1e-9, digits) + F.lit(0.0)


def sql_rnd(expr: str, digits: int = 6) -> str:
    return f"(round(({expr}) + 1e-9, {digits}) + 0.0)"


LONG = """
lng AS (
  SELECT user_id AS run_id, event_type AS metric, value, event_id, ts,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
         date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) / 1e6 AS t
  FROM events)"""

SENSOR = LONG + """,
sen AS (
  SELECT run_id, seq, t,
         CASE metric WHEN 'view' THEN 'ambient' WHEN 'click' THEN 'cpu_0_temp' WHEN 'purchase' THEN 'cpu_1_temp'
                     WHEN 'signup' THEN 'cam_cpu' ELSE 'work_done' END AS metric,
         CASE WHEN metric = 'error' THEN sum(CASE WHEN metric = 'error' THEN value END) OVER (PARTITION BY run_id ORDER BY seq)
              ELSE value END AS value
  FROM lng)"""

# Row-order neighbours of two metrics on every row of the run.
def neighbours(metrics: list[str], source: str = "sen") -> str:
    cells, around = [], []
    for m in metrics:
        v = f"CASE WHEN metric = '{m}' THEN value END"
        t = f"CASE WHEN metric = '{m}' THEN t END"
        prev = "OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        nxt = "OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        cells.append(f"{v} AS {m}_v, last_value({v} IGNORE NULLS) {prev} AS {m}_pv, last_value({t} IGNORE NULLS) {prev} AS {m}_pt,"
                     f" first_value({v} IGNORE NULLS) {nxt} AS {m}_nv, first_value({t} IGNORE NULLS) {nxt} AS {m}_nt")
        around.append(f"coalesce({m}_v, {m}_pv + (({m}_nv - {m}_pv) * (t - {m}_pt)) / nullif({m}_nt - {m}_pt, 0)) AS {m}")
        around.append(f"{m}_pv, {m}_nv, {m}_v")
    return f"""
nb AS (SELECT run_id, seq, t, metric, {', '.join(cells)} FROM {source}),
itp AS (SELECT run_id, seq, t, metric, {', '.join(around)} FROM nb)"""
