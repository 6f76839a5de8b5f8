"""The query language and its compilation to DataFrame plans."""
