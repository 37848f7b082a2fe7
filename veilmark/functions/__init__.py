"""Column-level building blocks: numbers, text, geometry and histograms."""
