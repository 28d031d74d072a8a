"""Connected components of a link table."""

from trawl.operators.components import components

__all__ = ["components"]
