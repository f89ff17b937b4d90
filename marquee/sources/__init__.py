"""Typed rows from fetched pages: links, cards, JSON-LD and line catalogues."""
