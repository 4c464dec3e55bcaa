"""Structured Streaming forms of the crawl operators."""
