"""presslink: news article assembly, mention extraction and contribution matching on Spark."""

__version__ = "0.1.0"
