"""The text operators' queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quern.llm import decontam, html, licenses, lm, media, neardup, oracles, packing, quality, secrets, urls

MODULES = [html, secrets, media, urls, packing, neardup, lm, decontam, quality, licenses]


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run} | {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for module in [*MODULES, oracles] for name, sql in module.ORACLE_SQL.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
