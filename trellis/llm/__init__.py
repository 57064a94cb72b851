"""Corpus operators for building training data; nothing else imports this package."""
