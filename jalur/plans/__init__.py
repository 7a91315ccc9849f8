"""The batch pipeline, and the queries of the driver contract."""
