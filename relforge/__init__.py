"""relforge: a small, strict, PostgreSQL-shaped relational engine on PySpark."""
