"""functions of the asset engine."""
