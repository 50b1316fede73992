"""Lorecraft: learning-and-knowledge analytics as plain DataFrame-to-DataFrame functions on Spark."""
