"""Readers that turn request bodies, OTLP exports, queues and dead-letter files into event rows."""
