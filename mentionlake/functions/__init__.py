"""functions of mentionlake."""
