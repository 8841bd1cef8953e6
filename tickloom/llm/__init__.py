"""Jobs that prepare text corpora for training: one module per operator, plus their queries."""

from tickloom.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
