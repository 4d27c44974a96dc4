"""The analyses, composed from sources, functions and operators. Each takes and returns DataFrames."""
