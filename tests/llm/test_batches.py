"""Arrow batches of whole texts are bounded by bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

from cutline import session
from cutline.llm import lm


def test_batches_of_long_texts_are_bounded(spark):
    docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"), F.lit(1).alias("fold"))
    largest = lambda: docs.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in it), "n bigint").agg(F.max("n")).first()[0]
    try:
        spark.conf.unset(session.ARROW_BYTES)
        assert {r["n_tokens"] for r in lm.score(docs, "fold").collect()} == {20_001}
        assert largest() < 2 * session.TEXT_BATCH_BYTES
        spark.conf.set(session.ARROW_BYTES, str(64 << 20))
        session.small_batches(spark)
        assert largest() > 2 * session.TEXT_BATCH_BYTES
    finally:
        spark.conf.unset(session.ARROW_BYTES)
