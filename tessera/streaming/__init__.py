"""Replay of append-only event logs as Structured Streaming queries."""

from .follow import Cursor, follow, page, replay_table

__all__ = ["Cursor", "follow", "page", "replay_table"]
