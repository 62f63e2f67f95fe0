"""Contact intelligence over large tables, written as PySpark DataFrame jobs."""
