import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.operators import resolve
from graphloom.sources import code


def _files(spark, n):
    """Files of one task, as a listing or a small table gives them."""
    k = F.col("id").cast("string")
    return spark.range(n).select(F.concat(F.lit("m"), k).alias("module"), F.concat(F.lit("m"), k, F.lit(".py")).alias("file"), F.concat(F.lit("x = "), k).alias("content")).coalesce(1)


def test_files_are_parsed_by_several_tasks(spark):
    files = _files(spark, 600)
    parsed = code.facts(files)
    assert files.rdd.getNumPartitions() == 1 and parsed.rdd.getNumPartitions() > 1
    assert code.of(parsed, "file").select("file").distinct().count() == 600 == code.of(parsed, "file").count()


def test_tasks_grow_with_files_and_with_what_they_hold(spark):
    files = _files(spark, 600)
    by_number, by_length = code.dealt(files, 100), code.dealt(files, characters=600)
    assert by_number.rdd.getNumPartitions() == 6 and by_length.rdd.getNumPartitions() == -(-files.agg(F.sum(F.length("content"))).first()[0] // 600)
    for rows in (by_number, by_length):
        assert rows.exceptAll(files).isEmpty() and rows.count() == 600
    assert max(r[0] for r in by_number.groupBy(F.spark_partition_id()).count().select("count").collect()) < 200
    assert code.dealt(files.limit(0)).count() == 0


def test_first_ways_over_batches():
    """Groups that batches cut, one whose first way goes round, and one that leads nowhere."""
    rows = [("a", "a", "b", False), ("a", "a", "z", True), ("a", "b", "a", False), ("c", "c", "d", False), ("c", "d", "c", False), ("e", "e", "f", False), ("e", "f", "g", False), ("e", "g", "y", True)]
    for size in (1, 2, 3, 8):
        cuts = [pa.RecordBatch.from_pylist([dict(zip(("alias", "at", "next", "end"), r)) for r in rows[k : k + size]]) for k in range(0, len(rows), size)]
        found = [tuple(r.values()) for b in resolve._first_ways(iter(cuts)) for r in b.to_pylist()]
        assert found == [("a", "z", 1), ("e", "y", 3)]
    assert [b.num_rows for b in resolve._first_ways(iter([]))] == [0]
