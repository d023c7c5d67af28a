"""Structured Streaming forms of the state folds. Each gives the same rows as its batch form."""
