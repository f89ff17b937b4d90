"""Marquee: event-listing analytics as Spark DataFrame programs."""
