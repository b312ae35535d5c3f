"""Inventory, purchasing and fulfilment analytics as Spark DataFrame jobs.

Every operator is a function from domain tables (:class:`stocklens.sources.tables.Tables`)
to a lazy DataFrame built from Spark SQL expressions.
"""

from stocklens.sources.tables import Tables, open_tables

__all__ = ["Tables", "open_tables"]
