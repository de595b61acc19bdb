"""All operations, registered by name."""

from . import aggregates, columns, dates, expressions, filters, geo, joins, quality, security, sets, texts  # noqa: F401
from ..relation import OPERATIONS, apply

__all__ = ["OPERATIONS", "apply"]
