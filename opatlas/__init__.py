"""Spark-native analytics over captured API traffic.

Traffic tables go in, a catalogue of the API operations seen in them comes out:
extract -> classify -> deduplicate, then reports, an inferred schema and CSV/SDL
exchange on top.  Logs only: no request is sent and no captured script is run.
"""
