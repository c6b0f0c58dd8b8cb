"""Named queries over the test tables, each with an independent SQL text where SQL can say it."""

from .registry import ORACLES, QUERIES
from . import aggregates, cleaning, joins, lists, modelling, scalars, storage, streams, validation, windows  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
