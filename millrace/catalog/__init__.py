"""The registered queries: each runs one operator over the whole given tables,
beside the DuckDB SQL that must return the same rows where SQL can say it."""

from importlib import import_module

from millrace.catalog.registry import ORACLES, QUERIES

FAMILIES = ("corpus", "finetune", "tokens", "scores", "retrieval", "runs", "features", "streams")


def _load() -> None:
    for family in FAMILIES:
        import_module(f"millrace.catalog.{family}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)
