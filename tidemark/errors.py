"""Typed errors and the statuses of navigation."""

from __future__ import annotations

from enum import Enum


class EngineError(Exception):
    """Any refusal of the engine; ``code`` is a short name."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class ExpressionError(EngineError):
    """An expression that can't be read or typed."""


class UniqueError(EngineError):
    """A key that must be unique occurs twice."""


class RelationTerminated(EngineError):
    """A lookup of a terminating relation found nothing."""


class Status(Enum):
    """Where a seek or a skip has landed."""

    FOUND = "found"
    AFTER = "after"
    BEFORE = "before"
    EOF = "eof"
    BOF = "bof"
    NO_RECORD = "no record"
