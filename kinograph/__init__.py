"""Frame-indexed feature tables from time-stamped annotations of recordings, on Spark."""
