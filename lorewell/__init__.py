"""lorewell: a PySpark engine that builds, queries and audits literature knowledge graphs."""
