"""tessera: a keyed dataset algebra expressed on Spark DataFrames."""
