"""Sources of the contract engine."""
