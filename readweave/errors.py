"""Errors of the engine."""

from __future__ import annotations


class ReadweaveError(Exception):
    """Base of all errors raised by this package."""


class SpecError(ReadweaveError):
    """A construct specification that cannot be used; holds all problems found."""

    def __init__(self, problems: list[str]) -> None:
        self.problems = problems
        super().__init__("; ".join(problems))


class LibraryError(ReadweaveError):
    """A library that cannot be used with its specification."""


class RecordError(ReadweaveError):
    """A sequence file that cannot be parsed."""


class PairError(ReadweaveError):
    """Forward and reverse files of different length."""


class OptionError(ReadweaveError):
    """Options that do not go together."""
