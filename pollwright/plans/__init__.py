"""Whole questions composed from the operators, each one lazy plan."""
