"""Table-to-table operators: DataFrames in, DataFrames out, column names as parameters."""
