"""evalloom: fine-tuning data, grading, leaderboard and run-log jobs on Spark DataFrames."""

from evalloom.session import build_session

__all__ = ["build_session"]
