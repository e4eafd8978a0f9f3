"""Whole jobs, the test fixtures they run on, and the registered queries."""
