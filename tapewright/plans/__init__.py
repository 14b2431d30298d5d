"""The registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapewright.plans import formula_queries, gate_queries, indicator_queries, join_queries, ledger_queries, model_queries, simulation_queries, source_queries, stream_queries, structure_queries

MODULES = [formula_queries, gate_queries, indicator_queries, join_queries, ledger_queries, model_queries, simulation_queries, source_queries, stream_queries, structure_queries]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
#: Columns whose SQL type follows from its literals and is not that of the query: name -> (type, columns).
TYPES = {
    "c10_entry_gates": ("INTEGER", "passed"),
    "c14_macro_gate": ("DOUBLE", "signal"),
    "c15_term_structure_gate": ("DOUBLE", "signal"),
    "c16_crowding": ("DOUBLE", "factor"),
    "d03_next_event": ("INTEGER", "days_to_next days_since_last"),
    "d13_parameter_grid": ("DOUBLE", "stop target"),
    "e49_veto_health": ("DOUBLE", "health"),
    "f79_streaks": ("INTEGER", "since_win"),
    "f80_trailing_losses": ("INTEGER", "losses"),
    "f84_cross_section": ("INTEGER", "strength"),
    "f91_momentum_size": ("DOUBLE", "factor"),
    "g01_sorted_metric": ("INTEGER", "place"),
    "g02_top_conviction": ("INTEGER", "place"),
    "h06_purged_folds": ("INTEGER", "fold"),
    "i01_sentiment": ("INTEGER", "good bad"),
    "i03_headline_polarity": ("DOUBLE", "score"),
    "i07_calendar_features": ("DOUBLE", "factor"),
    "i16_smile": ("DOUBLE", "factor"),
    "i26_implied_volatility": ("DOUBLE", "implied"),
    "i34_allocation_caps": ("DOUBLE", "allocation"),
    "i35_option_layer": ("DOUBLE", "score"),
    "i39_risk_envelope": ("DOUBLE", "size"),
    "k18_threshold_choice": ("DOUBLE", "tau"),
}


def typed(name: str, sql: str) -> str:
    if name not in TYPES:
        return sql
    kind, columns = TYPES[name]
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {kind}) AS {c}' for c in columns.split())}) FROM ({sql})"


SQL: dict[str, str] = {k: typed(k, v) for m in MODULES for k, v in m.SQL.items()}
