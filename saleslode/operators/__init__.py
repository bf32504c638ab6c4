"""Reusable frame-to-frame operators."""
