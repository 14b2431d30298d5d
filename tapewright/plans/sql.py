"""Pieces of the DuckDB SQL that checks the queries: the same inputs, written independently."""

from __future__ import annotations

TICKS = """ticks AS (SELECT event_type AS symbol, ts, event_id, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, user_id FROM events)"""

BARS = f"""{TICKS},
bars0 AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts, event_id)) AS close, sum(size) AS volume, count(*) AS n_ticks FROM ticks GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar_no FROM bars0)"""

TRADES = """trades AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS trade_id, l_orderkey AS order_id, l_linenumber AS line_no, l_returnflag AS strategy,
  l_linestatus AS system, o_orderpriority AS regime, l_shipdate AS exit_ts, o_orderdate AS entry_ts, l_quantity AS quantity, l_extendedprice AS notional,
  round(l_extendedprice * (1 - l_discount) - l_extendedprice * (0.9 + l_tax), 4) AS pnl,
  round(round(l_extendedprice * (1 - l_discount) - l_extendedprice * (0.9 + l_tax), 4) / (l_extendedprice * 0.05), 4) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

MACRO = """macro AS (SELECT day + to_days(CAST(date_diff('day', max(day) OVER (), DATE '2024-01-31') AS INTEGER)) AS day, value
  FROM (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS value FROM orders GROUP BY 1))"""


def w(n: int, skip: int = 0) -> str:
    """The frame of n rows ending skip rows back."""
    return f"OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {n - 1 + skip} PRECEDING AND {skip} PRECEDING)" if skip else f"OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


BY = "OVER (PARTITION BY symbol ORDER BY bar_no)"


def full(agg: str, x: str, n: int, skip: int = 0) -> str:
    return f"CASE WHEN count({x}) {w(n, skip)} = {n} THEN {agg}({x}) {w(n, skip)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {BY}"


def band(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} > {hi} THEN 1 WHEN {x} < {lo} THEN -1 ELSE 0 END"


def steps(*ctes: tuple[str, str], raw: str = "raw", state: str = "0", last: str | None = None, base: str = BARS) -> str:
    """A query over named steps; the last one gives symbol, bar_no, raw, and what the state is made of."""
    parts = ", ".join(f"{name} AS ({body})" for name, body in ctes)
    last = last or ctes[-1][0]
    return f"WITH {base}, {parts}, fin AS (SELECT symbol, bar_no, {raw} AS raw, * EXCLUDE (symbol, bar_no{', raw' if raw == 'raw' else ''}) FROM {last}) SELECT symbol, bar_no, round(raw, 6) AS raw, CAST(coalesce({state}, 0) AS INTEGER) AS state FROM fin"


def ewm_cte(name: str, source: str, x: str, alpha: str, keep: str = "") -> str:
    """Recursive mean without adjustment, a bar at a time; x must not be null."""
    return f"{name} AS (SELECT symbol, bar_no, {x} AS e FROM {source} WHERE bar_no = 1 UNION ALL SELECT b.symbol, b.bar_no, {alpha} * b.{x} + (1 - {alpha}) * p.e FROM {name} p JOIN {source} b ON b.symbol = p.symbol AND b.bar_no = p.bar_no + 1)"


def wilder_cte(name: str, source: str, x: str, n: int) -> str:
    """Recursive mean with adjusted weights and a warm-up of n rows; rows with null x come first and do not count."""
    a = f"(1.0 / {n})"
    return (
        f"{name}_s AS (SELECT symbol, bar_no, {x} AS x, count({x}) {BY} AS k FROM {source}), "
        f"{name}_r AS (SELECT symbol, bar_no, x AS num, CAST(1 AS DOUBLE) AS den, k FROM {name}_s WHERE k = 1 AND x IS NOT NULL "
        f"UNION ALL SELECT b.symbol, b.bar_no, b.x + (1 - {a}) * p.num, 1 + (1 - {a}) * p.den, b.k FROM {name}_r p JOIN {name}_s b ON b.symbol = p.symbol AND b.bar_no = p.bar_no + 1), "
        f"{name} AS (SELECT symbol, bar_no, CASE WHEN k >= {n} THEN num / den END AS e FROM {name}_r)"
    )
