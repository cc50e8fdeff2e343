"""Field-map specs compiled to Column expressions, and the configured end-to-end run."""
