"""Column functions: tokens, terms, sentences and small array statistics."""
