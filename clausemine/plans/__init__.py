"""The operators composed: learn, predict, evaluate."""
