"""Operators on long panels (code, date, measures)."""
