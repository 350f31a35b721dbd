"""Connected components of links between documents or lines."""

from ..operators.graph import connected as connected_components

__all__ = ["connected_components"]
