"""Sources and sinks: raw CSV load, fixture adapters, table storage."""

from churnkit.sources.csv import read_raw_csv, write_raw_csv
from churnkit.sources.schemas import RAW_ACTIVITY, RAW_CUSTOMERS, RAW_PRODUCTS, RAW_SCHEMAS

__all__ = ["RAW_ACTIVITY", "RAW_CUSTOMERS", "RAW_PRODUCTS", "RAW_SCHEMAS", "read_raw_csv", "write_raw_csv"]
