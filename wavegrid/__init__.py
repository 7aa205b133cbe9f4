"""DataFrame operators for annotated-interval datasets."""
