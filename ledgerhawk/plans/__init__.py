"""Named queries over the driver tables (``catalog.QUERIES``) and their
DuckDB oracle SQL (``catalog.ORACLE``)."""
