"""Table-to-table transforms."""
