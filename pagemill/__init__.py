"""Document analytics on Spark: letters, words, search, redaction, audits and corpus reports as DataFrames."""

from pagemill.session import build_session, table

__all__ = ["build_session", "table"]
