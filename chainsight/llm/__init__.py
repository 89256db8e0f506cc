"""Training-data operators: one module per operator, ``queries.py`` registers one query each."""
