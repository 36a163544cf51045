"""Sources, sinks, schemas and the adapters from the driver tables."""
