"""Column builders: time-series frames, cross-sections and scalars."""
