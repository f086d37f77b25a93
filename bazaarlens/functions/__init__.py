"""Column-expression builders shared by batch and streaming operators."""
