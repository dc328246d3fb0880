"""Reading and writing audio."""
