"""tessera: relational, graph, evidence and text-extraction analytics on PySpark DataFrames."""
