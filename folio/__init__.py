"""Folio: document retrieval, table analytics and corpus auditing as Spark plans."""
