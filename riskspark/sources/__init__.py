"""Sources and sinks."""

from riskspark.sources.readers import SourceError, literal_vectors, read_csv, read_parquet
from riskspark.sources.sinks import write_reports, write_table
from riskspark.sources.tables import ACCIDENT_ROLES, ACCIDENT_SQL, accident_frame, table

__all__ = [
    "ACCIDENT_ROLES", "ACCIDENT_SQL", "SourceError", "accident_frame", "literal_vectors",
    "read_csv", "read_parquet", "table", "write_reports", "write_table",
]
