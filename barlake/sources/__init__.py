"""Readers, writers and derived relations."""
