"""Batch and streaming jobs for legal text corpora on Spark."""
