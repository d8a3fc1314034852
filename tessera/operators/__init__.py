"""DataFrame -> DataFrame operators, one module per body of computation."""
