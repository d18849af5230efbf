"""Rule-driven structural analytics over code and documents, as Spark plans."""
