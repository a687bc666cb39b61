"""Weekly tables derived from the given tables, and the SQL that checks the queries."""
