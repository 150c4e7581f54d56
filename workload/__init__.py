"""The registered queries: the library run over the given tables, and the SQL they must equal."""
