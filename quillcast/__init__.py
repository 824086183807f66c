"""quillcast: content-feed digests as Spark jobs.

Every operator takes and returns DataFrames, so jobs are built with
``df.transform`` and ordinary function calls and stay one lazy plan.
"""
