"""Connected components, from the operators of the engine."""

from pointlens.operators.components import connected_components

__all__ = ["connected_components"]
