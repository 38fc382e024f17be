"""Event sources, result sinks and intermediate tables."""
