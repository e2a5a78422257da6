"""Sources and sinks: source trees, snapshots, and what parses files into symbols."""
