"""Building blocks; each takes DataFrames and settings and returns a DataFrame."""
