"""Reading, appending to, exporting and archiving tables."""
