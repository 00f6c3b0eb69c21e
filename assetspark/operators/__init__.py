"""operators of the asset engine."""
