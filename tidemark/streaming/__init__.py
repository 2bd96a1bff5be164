"""Live counterparts of the history operators."""
