"""Ticks to intraday bars, signals, daily deduplication and alerts."""
