"""The library's named queries."""

from tessera.plans import evaluation_queries, graph_queries, registry, retrieval_queries  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
