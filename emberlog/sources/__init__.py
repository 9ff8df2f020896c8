"""Sources: framing, timestamps and tags around Spark's readers, for batches and streams; sinks."""
