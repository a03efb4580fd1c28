"""Queries over the supplied tables, with their SQL counterparts."""

from __future__ import annotations

from textquarry.plans import corpus, detection, files, flagship, logs, more, prevalence, reports, streams

QUERIES = {"flagship_app_summary": flagship.app_summary} | detection.QUERIES | corpus.QUERIES | more.QUERIES | files.QUERIES | streams.QUERIES | logs.QUERIES | reports.QUERIES | prevalence.QUERIES
ORACLE_SQL = {"flagship_app_summary": flagship.SQL} | detection.ORACLE_SQL | corpus.ORACLE_SQL | more.ORACLE_SQL | files.ORACLE_SQL | streams.ORACLE_SQL | logs.ORACLE_SQL | reports.ORACLE_SQL | prevalence.ORACLE_SQL
