"""Plans of the duplicate engine."""
