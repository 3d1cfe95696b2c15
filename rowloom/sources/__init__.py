"""Sources and sinks: CSV, the Parquet table store and the interchange binary file."""
