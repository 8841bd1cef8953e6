"""Market-data jobs on Spark: normalise, validate, merge, query and report."""

from tickloom.session import build_session, configure, shared_dir

__all__ = ["build_session", "configure", "shared_dir"]
