"""Experiment-catalogue analytics on Spark."""
