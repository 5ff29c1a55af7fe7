"""The queries of this package and their DuckDB twins, for the driver contract."""

from __future__ import annotations

import corpus_pipeline
from spanloom.llm import chat, licenses, mixing, near_dedup, packing, quality, token_counts, token_store, topk, warc

MODULES = [chat, licenses, mixing, near_dedup, packing, quality, token_counts, token_store, topk, warc]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
