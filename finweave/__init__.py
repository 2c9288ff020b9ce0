"""finweave: Spark-native financial analytics over company facts, prices,
macro series and filing text."""
