"""Queries and their SQL for the driver."""

from __future__ import annotations

from .oracles import ORACLES
from .queries import QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
