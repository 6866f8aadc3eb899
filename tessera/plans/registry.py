"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from tessera.plans import check_queries, corpus_queries, ledger_queries, retrieval_queries, review_queries, store_queries, stream_queries, unit_queries
from tessera.session import visible

_MODULES = (corpus_queries, check_queries, retrieval_queries, ledger_queries, review_queries, store_queries, stream_queries, unit_queries)


def _ready(f):
    return lambda spark, sf_dir: f(visible(spark), sf_dir)


QUERIES = {name: _ready(f) for module in _MODULES for name, f in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
