"""Jobs composed of operators; each module also runs under spark-submit."""
