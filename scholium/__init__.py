"""scholium: corpus, retrieval and citation-graph analytics as PySpark DataFrame operators."""
