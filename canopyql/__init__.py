"""canopyql: path queries, validation and data preparation over hierarchical documents, on Spark."""
