"""Name -> query and name -> oracle SQL, gathered from the query modules."""

from __future__ import annotations

from stallwise.plans import backtest_queries, check_queries, decision_queries, experiment_queries, feature_queries, model_queries, panel_queries, scoring_queries, subset_queries, triage_queries

MODULES = (panel_queries, feature_queries, backtest_queries, decision_queries, triage_queries, check_queries, model_queries, experiment_queries, scoring_queries, subset_queries)
QUERIES: dict = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict = {name: text for m in MODULES for name, text in m.ORACLE_SQL.items()}
