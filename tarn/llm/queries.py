"""All registered queries of the operators, and their SQL."""

from __future__ import annotations

import importlib

MODULES = (
    "fingerprints",
    "ngram_join",
    "mixing",
    "toxicity",
    "quality",
    "chat",
    "packing",
    "html",
    "sharding",
    "compression",
    "line_dedup",
    "runs",
    "collocations",
)


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(importlib.import_module(f"tarn.llm.{name}"), attribute))
    return merged


def queries() -> dict:
    import corpus_pipeline

    return {**_collect("QUERIES"), **corpus_pipeline.QUERIES}


def oracle() -> dict:
    import corpus_pipeline

    own = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {**_collect("ORACLE"), **own}
