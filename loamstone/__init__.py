"""loamstone: a document-knowledge engine whose every operator is a Spark plan."""
