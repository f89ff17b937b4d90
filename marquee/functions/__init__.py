"""Column functions on text, dates and event identity."""
