"""quillspark: Spark jobs over large collections of curated notes and work sessions."""

__version__ = "0.1.0"
