"""Spark-native analytics for paired-image evaluation."""

from agreemill.api import STRIPPERS, PairScorer
from agreemill.functions.text import strip_subject
from agreemill.session import session

__all__ = ["STRIPPERS", "PairScorer", "session", "strip_subject"]
