"""Streaming of tidemark."""
