"""Training-data operators on tables of texts, conversations and vectors. Nothing outside this package imports it."""
