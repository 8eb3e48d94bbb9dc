"""Operators for training data: splitting, origin, top-N, credentials, syntax, shared spans, tokens, mixing, sentences."""
