"""Structured Streaming jobs: packet reassembly, stale filter, statistics, latest-wins sinks."""
