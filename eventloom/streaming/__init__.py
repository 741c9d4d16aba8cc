"""Structured Streaming jobs: stateful dedupe, fan-out delivery, live tail and rates."""
