"""Connected components, as the operators have them."""

from corpusgraph.operators.components import components

__all__ = ["components"]
