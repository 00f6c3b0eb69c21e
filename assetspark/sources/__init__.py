"""sources of the asset engine."""
