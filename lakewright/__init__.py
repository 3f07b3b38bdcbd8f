"""An analytics engine on PySpark: a SQL surface with MySQL and T-SQL spellings, checked DML on Parquet snapshots."""
