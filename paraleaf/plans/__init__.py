"""Plan helpers: reading tables, cutting lineage, sizing shuffles."""
