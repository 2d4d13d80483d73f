"""Plans of the contract engine."""
