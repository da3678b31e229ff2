"""spectrel: Spark-native analytics for spectra, documents and events."""
