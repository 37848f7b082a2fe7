"""Readers and writers for projects, rules, presets, media files, boxes and reports."""
