"""draftlake: Spark-native analytics over decoded engineering-drawing corpora."""
