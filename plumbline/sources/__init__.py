"""Record sources and result sinks."""
