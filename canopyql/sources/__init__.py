"""Documents from tables and from files."""
