"""Postal-address standardisation, matching and serving as Spark DataFrame plans."""
