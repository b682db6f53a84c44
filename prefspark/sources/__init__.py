"""Readers and writers, and inputs derived from the test tables."""
