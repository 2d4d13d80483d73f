"""Streaming of the contract engine."""
