"""nestlake: nested-content analytics on Spark (dissection, tree queries, detection scenarios)."""

__version__ = "0.1.0"
