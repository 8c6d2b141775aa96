"""CorpusGraph: document-intelligence operators as PySpark DataFrame transforms."""
