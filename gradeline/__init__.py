"""gradeline: grade-profile matching and data preparation on Spark."""
