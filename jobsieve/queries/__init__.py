"""Registered queries: each operator over whole tables, with the equivalent SQL where there is one."""

from __future__ import annotations

from . import documents, edits, funnel, layout, outreach, sourcing, streams  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
