"""sinks of mentionlake."""
