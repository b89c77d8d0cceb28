"""Log analytics as DataFrame jobs: search, error detection, clustering, tracing, latency, fleet health."""
