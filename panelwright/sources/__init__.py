"""Releases in, versioned tables out, and adapters over order tables."""
