"""Episode datasets and evaluation reports as Spark DataFrame jobs."""

__all__ = ["dims", "session", "workspace"]
__version__ = "0.1.0"
