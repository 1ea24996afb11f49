"""Tapeloom: technical signals and backtests over daily price bars, as Spark jobs."""
