"""Lodestrand plans."""
