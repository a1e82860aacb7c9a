"""Operators for training-data pipelines: one module per operator, ``queries`` and ``oracles`` register them."""
