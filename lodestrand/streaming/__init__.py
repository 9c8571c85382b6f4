"""Lodestrand streaming."""
