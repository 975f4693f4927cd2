"""Structured Streaming operators (incremental ingestion, live leaderboard)."""
