"""Table plans: schema descriptors, metadata and the import / export pipelines."""
