"""Sources and sinks: fact files, source trees, version history, sampling profiles."""
