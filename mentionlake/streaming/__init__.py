"""streaming of mentionlake."""
