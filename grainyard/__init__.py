"""Grainyard: training-corpus preparation and completion scoring on Spark."""
