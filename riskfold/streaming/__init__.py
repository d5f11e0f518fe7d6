"""Streaming: the evaluated workflow is batch-only (no watermarks, windows over
event time, state or late data), so nothing here runs as a stream.  Results
are appended as tables per (endpoint, seed, model, fold) by the batch plans."""
