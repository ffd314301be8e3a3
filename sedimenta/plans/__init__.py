"""Query plans of the library."""
