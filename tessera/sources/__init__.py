"""Table and file sources."""

from .tables import TABLES, load, load_all

__all__ = ["TABLES", "load", "load_all"]
