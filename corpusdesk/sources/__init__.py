"""Readers, writers and table stores."""
