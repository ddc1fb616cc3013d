"""revlens: review insight on Spark.

Turns landed web pages and free-text reviews into a queryable table, indexes the
text as vectors, and answers batches or streams of questions over it with
filtered cosine top-k retrieval and grounded prompts.  Every operator is a
``DataFrame -> DataFrame`` function that takes column names as parameters, so it
can be chained with ``DataFrame.transform``.
"""

from revlens.session import checkpoint_dir, get_session, load_table, scratch_path

__all__ = ["checkpoint_dir", "get_session", "load_table", "scratch_path"]
