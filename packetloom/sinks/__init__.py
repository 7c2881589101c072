"""Captures and pages as bytes."""
