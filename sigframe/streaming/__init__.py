"""Stateful processors for unbounded frames."""
