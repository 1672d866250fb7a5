"""DataFrame operators of the ingest, search and evaluation plans."""
