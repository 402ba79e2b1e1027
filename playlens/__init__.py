"""Player analytics on Spark: sessions, players, islands, transactions, cohorts and chat turns."""

from playlens.session import build_session, workspace

__all__ = ["build_session", "workspace"]
