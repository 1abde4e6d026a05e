"""Graph sources and sinks: files, and conflict graphs of relational tables."""
