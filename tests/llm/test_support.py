"""Written tables."""

import pyarrow as pa
from pyspark.sql import functions as F

from tickloom.llm import collocations, support


def test_batches_of_large_rows_are_small(spark):
    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    table = support.written(rows, "large-rows")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    found = [r.n for r in table.coalesce(1).mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 40 << 20
    assert max(found) < support.BATCH_BYTES + (2 << 20)


def test_packs_are_read_a_few_at_a_time(spark, monkeypatch):
    key, seen = "spark.sql.parquet.columnarReaderBatchSize", []

    def counted(frame, purpose, **options):
        seen.append((purpose, int(spark.conf.get(key)), options))
        return support.written(frame, purpose, **options)

    before = spark.conf.get(key)
    monkeypatch.setattr(collocations, "written", counted)
    docs = spark.createDataFrame([("a b " * 20, "en")], "text string, lang string")
    assert collocations.collocations(docs).collect()
    at = {purpose: rows for purpose, rows, _ in seen}
    assert at["marks"] <= 8 and at["phrases"] <= 8 and spark.conf.get(key) == before
    assert [o for p, _, o in seen if p == "packs"] == [{"parquet.block.size": 4 * collocations.PACK}]
