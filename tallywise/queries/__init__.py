"""The registered queries of the library and their SQL, by module."""
