"""Readers, writers and captured-page sources."""
