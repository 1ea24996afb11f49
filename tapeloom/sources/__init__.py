"""Readers: candles from raw tables and stores, symbols, constituents, instruments and ticks."""
