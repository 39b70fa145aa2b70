"""Relational operators over bars, events and identities."""
