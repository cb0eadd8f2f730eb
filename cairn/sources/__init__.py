"""Readers: tables, and their projections onto the memory store's relations."""
