"""Connected components, as the library's operators find them."""

from ..operators.graph import components

__all__ = ["components"]
