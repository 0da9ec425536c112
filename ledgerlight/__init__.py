"""Spark-native business-data analytics: profile, clean, classify, measure, model, predict."""
