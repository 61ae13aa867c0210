"""docquarry: document ingestion, metadata, retrieval and scoring as Spark DataFrame pipelines."""
