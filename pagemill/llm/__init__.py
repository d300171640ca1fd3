"""Training-data operators; see README for the list. Nothing else in the package imports this."""
