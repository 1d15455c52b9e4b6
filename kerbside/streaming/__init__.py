"""Structured Streaming jobs: watermark, trigger and sink around the batch operators."""
