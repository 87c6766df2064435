from ratelens.sources.readers import read_collection, read_result_csv, read_table, table_path
from ratelens.sources.sinks import csv_safe, save_full, save_preview

__all__ = ["read_table", "read_collection", "read_result_csv", "table_path",
           "csv_safe", "save_preview", "save_full"]
