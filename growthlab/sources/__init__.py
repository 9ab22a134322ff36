"""Sources, sinks, schema contracts and the canonical fixture views."""
