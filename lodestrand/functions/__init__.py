"""Lodestrand functions."""
