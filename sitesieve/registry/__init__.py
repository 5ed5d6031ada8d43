"""The operators wired to the standard test tables."""
