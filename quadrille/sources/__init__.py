"""Tables, derived geometry, mesh files."""
