"""A Spark-first knowledge and search engine over source trees, documents, pages and conversations."""
