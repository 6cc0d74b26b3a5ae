"""chunkwell: seekable record files, message toolkits and corpus operators on PySpark."""
