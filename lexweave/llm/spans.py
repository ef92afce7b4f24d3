"""Spans found in a text, shared by the scanners."""

from __future__ import annotations

Span = tuple[str, int, int]  # kind, start, end in code points, end exclusive
