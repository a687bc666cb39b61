"""Reading and writing tables, and copying them out of a database."""
