"""The reference has no streaming operator (no watermark, window, state or
stream source), so nothing is built here; batch retrieval already runs one
job per query batch."""
