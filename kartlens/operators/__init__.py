"""The analysis steps, one function per query, each returning a DataFrame."""
