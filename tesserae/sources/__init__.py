"""Readers with explicit schemas, and the extraction that turns raw records into items."""
