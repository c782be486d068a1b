"""longreach: a Spark-first engine that turns a text corpus into long-context training data."""

__version__ = "0.1.0"
