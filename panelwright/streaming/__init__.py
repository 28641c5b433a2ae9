"""Refresh driven by landing files."""
