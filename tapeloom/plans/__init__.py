"""End-to-end plans: backtests, reports, the scanner."""
