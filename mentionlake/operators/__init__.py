"""operators of mentionlake."""
