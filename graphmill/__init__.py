"""graphmill: building, maintaining and analysing large corpora of small graphs on Spark."""

__version__ = "0.1.0"
