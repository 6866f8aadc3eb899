"""tessera: Spark jobs for code-review data, written as DataFrame-to-DataFrame functions."""
