"""Table operators: DataFrames in, DataFrames out, nothing runs until the result is used."""
