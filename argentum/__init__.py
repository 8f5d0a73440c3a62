"""argentum: silver text datasets from coded events and free text, as Spark jobs."""

__version__ = "0.1.0"
