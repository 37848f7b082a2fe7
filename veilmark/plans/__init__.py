"""Shared plan shapes: skew-proof ordered windows, session settings and the full scan."""
