"""docquarry: document ingestion and retrieval as Spark DataFrame functions."""
