"""The registered queries and, for each, independent SQL over the same raw tables."""
