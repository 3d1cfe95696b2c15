"""Row numbering, batches, columns and per-batch metadata."""
