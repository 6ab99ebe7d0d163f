"""Session analytics on Spark: bars, headlines, features, linear models, evaluation."""
