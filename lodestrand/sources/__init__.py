"""Lodestrand sources."""
