"""Errors of the query language; ``code`` is stable."""

from __future__ import annotations


class QueryError(Exception):
    def __init__(self, code: str, message: str, line: int | None = None, column: int | None = None):
        at = f" at {line}:{column}" if line else ""
        super().__init__(f"{code}: {message}{at}")
        self.code, self.message, self.line, self.column = code, message, line, column
