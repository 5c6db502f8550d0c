"""Readers, writers and generated rows."""
