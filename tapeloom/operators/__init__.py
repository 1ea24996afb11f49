"""Signal rules, trade measurement, confluence and statistics."""
