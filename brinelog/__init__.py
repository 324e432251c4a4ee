"""Spark operators for instrument sample bins, image surveys and their products."""
