"""Operators for preparing text corpora and embeddings; nothing else imports them."""
