"""The pipeline over the supplied test tables, and the SQL each result is checked against."""
