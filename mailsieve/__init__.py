"""Content gateway for message corpora, written as ordinary Spark jobs."""

from mailsieve.policy import Policy

__all__ = ["Policy"]
