"""All registered queries and their SQL."""

from colloquy.catalog import align, documents, live, signal, stored, text, voices
from colloquy.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "align", "documents", "live", "signal", "stored", "text", "voices"]
