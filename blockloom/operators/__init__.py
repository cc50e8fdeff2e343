"""DataFrame operators, one module per step of corpus preparation."""
