"""Training-data operators: one module for each, ``queries`` holds the thin registered queries."""
