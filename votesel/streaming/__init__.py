"""Streaming: intentionally empty.

The reference is a batch job: it has no streams, watermarks, windows over
event time or state stores, so there is nothing here to rebuild. The package
exists so the layout stays uniform; see README for the coverage note.
"""
