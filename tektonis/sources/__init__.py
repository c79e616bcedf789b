"""Readers for the tables and file formats the engine works on."""

from tektonis.sources.tables import once, table  # noqa: F401
