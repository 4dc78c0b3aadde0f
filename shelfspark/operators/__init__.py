"""Rules that change or check table state: DataFrames in, DataFrames out."""
