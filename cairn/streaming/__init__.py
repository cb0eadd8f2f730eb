"""Streams: coalescing of message bursts, and reads by cursor."""
