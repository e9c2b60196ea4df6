"""tabulark: a Spark-native engine for question banks and line-structured documents."""

from tabulark.session import build_session

__all__ = ["build_session"]
