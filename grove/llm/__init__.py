"""Training-data operators: everything here works on plain DataFrames of texts."""
