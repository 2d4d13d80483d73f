"""Operators of the contract engine."""
