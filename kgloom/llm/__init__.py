"""Operators for preparing and curating text corpora and entity links for language-model training."""
