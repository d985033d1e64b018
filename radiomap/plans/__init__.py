"""Registered queries (``queries``) and their DuckDB oracle (``oracle_sql``)."""
