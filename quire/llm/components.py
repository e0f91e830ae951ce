"""Connected components of an edge table."""

from ..operators.components import components

__all__ = ["components"]
