"""Factloom: a Spark-native layer of evidence-backed facts."""
