"""Quarry: a catalogue of files and their metadata as Spark DataFrames."""
