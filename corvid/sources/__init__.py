"""Reading, parsing and storing repositories."""
