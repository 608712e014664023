"""The registered queries and, written apart from them, their SQL twins."""
