"""Continuous upsert of bars."""
