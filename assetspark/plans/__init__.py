"""plans of the asset engine."""
