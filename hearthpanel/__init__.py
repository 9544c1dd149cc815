"""Regional housing-market analytics expressed as Spark DataFrame jobs."""

from hearthpanel.session import build_session

__all__ = ["build_session"]
