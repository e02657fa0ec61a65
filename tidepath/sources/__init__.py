"""Readers for base tables and writers for results."""

from tidepath.sources.sinks import write_overview
from tidepath.sources.tables import SCHEMAS, read_tables
from tidepath.sources.warehouse import read_warehouse

__all__ = ["SCHEMAS", "read_tables", "read_warehouse", "write_overview"]
