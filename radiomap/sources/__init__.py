"""Sources: the driver's parquet tables, survey views derived from them, survey
CSV/Parquet readers and writers, small lookup tables."""
