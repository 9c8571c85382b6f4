"""Corpus preparation for language models. Nothing outside this subpackage imports it."""
