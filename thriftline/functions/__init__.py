"""Column -> Column building blocks shared by batch and streaming jobs."""
