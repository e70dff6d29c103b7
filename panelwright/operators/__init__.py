"""DataFrame in, DataFrame out; column names are parameters."""
