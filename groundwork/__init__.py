"""groundwork: curate, search and audit labelled text and feature tables with Spark."""

__version__ = "0.1.0"
