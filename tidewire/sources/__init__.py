"""Scanners that turn staged payload tables into raw items."""
