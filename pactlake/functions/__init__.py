"""Functions of the contract engine."""
