"""Table plans: validation and compilation to DataFrames."""
