"""Functions of the duplicate engine."""
