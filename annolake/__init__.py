"""Text annotation analytics on Spark: documents, spans, and the plans that relate them."""
