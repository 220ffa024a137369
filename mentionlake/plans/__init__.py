"""plans of mentionlake."""
