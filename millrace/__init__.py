"""millrace: Spark-native operators for curating, segmenting and scoring text and video corpora."""
