"""The pipeline language and its compilation to plans."""
