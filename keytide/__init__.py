"""keytide: put large collections of keyed binary records into global unsigned key order with Spark."""
