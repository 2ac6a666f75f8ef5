"""Corpus preparation over the project's text and quote records; nothing else in the package imports this."""
