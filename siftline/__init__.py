"""Spark-native triage, matching and reporting over large volumes of short text records."""
