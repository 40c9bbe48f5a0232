"""Sources and sinks: file listing, extraction cache, graph tables and documents."""
