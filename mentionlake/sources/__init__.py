"""sources of mentionlake."""
