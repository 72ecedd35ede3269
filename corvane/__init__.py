"""corvane: permission-aware retrieval, temporal memory and evaluation as Spark plans."""
