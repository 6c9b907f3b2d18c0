"""quern: chunking, retrieval and judge analytics as declarative PySpark plans."""

__version__ = "0.1.0"
