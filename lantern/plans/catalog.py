"""All registered queries of the library's own jobs."""

from . import chats, corpus, evaluation, reports, runs, safety, streams, texts, vectors
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chats", "corpus", "evaluation", "reports", "runs", "safety", "streams", "texts", "vectors"]
