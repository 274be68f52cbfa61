"""tessera: versioned key-value state, replicated logs and transaction histories as Spark DataFrames."""
