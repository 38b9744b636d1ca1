"""weftline: a Spark-native engine for preparing, measuring, mixing and scoring large text and speech corpora."""
