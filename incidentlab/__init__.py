"""Spatio-temporal incident analytics as plain PySpark DataFrame operators."""

from .columns import Columns, Settings

__all__ = ["Columns", "Settings"]
