"""The pipeline: staging builds, the stored layers (``Warehouse``), every
query of the reference by name (``QUERIES``) and their DuckDB oracles."""
