"""Relational and geometric operators on annotation tables."""
