"""forkline: versioned object collections and change-data analytics on Spark."""

__version__ = "0.1.0"
