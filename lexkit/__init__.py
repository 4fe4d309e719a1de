"""lexkit: lexical and vector retrieval analytics as Spark DataFrame plans.

Layout
------
functions/  column expressions (text normalisation, tokenisation, scoring terms,
            array edits, schedules, hash uniforms)
operators/  DataFrame -> DataFrame operators (postings, statistics, scoring joins,
            ranking windows, metrics, sampling, contrastive statistics, vectors,
            training steps)
sources/    readers / writers for the on-disk formats and the test-table mapping
plans/      end-to-end compositions (retrieval evaluation, answer recall, reader
            evaluation, rank agreement, contrastive statistics, reports)
streaming/  Structured Streaming forms of the carried running statistics
"""

from lexkit.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
