"""Marlstone: keyed, versioned tables, graphs and change streams on Spark."""
