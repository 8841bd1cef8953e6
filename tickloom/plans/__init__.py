"""Jobs composed of the operators, and the query catalog."""

__all__ = ["QUERIES"]


def __getattr__(name: str):
    """The catalog, which imports all that has a query, is built when it is asked for."""
    if name == "QUERIES":
        from tickloom.plans import read_queries, run_queries, write_queries  # noqa: F401
        from tickloom.plans.catalog import QUERIES

        return QUERIES
    raise AttributeError(name)
