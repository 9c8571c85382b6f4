"""Lodestrand operators."""
