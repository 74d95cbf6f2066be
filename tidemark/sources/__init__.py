"""Sources of the duplicate engine."""
