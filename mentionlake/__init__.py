"""mentionlake: a Spark-first engine for social posts, comments and documents.

Every operator is a function from DataFrames to a DataFrame; nothing runs until
the caller asks for rows.  The subpackage ``llm`` is optional and is imported by
no module outside itself.
"""

__version__ = "0.1.0"
