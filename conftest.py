"""Lets pytest find the package from the repository's root."""
