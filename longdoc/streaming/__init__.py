"""Streaming form of the row-local preparation steps.

The reference has no stream; B1-B3 and C1-C5 are row-local, so the same
expressions run unchanged on a streaming DataFrame (no state, no watermark).
"""
