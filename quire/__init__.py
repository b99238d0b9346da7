"""A Spark-native engine for searching, analysing and maintaining a corpus of long documents."""
