import random

from plain import random_dna
from strandlake import HashSpec
from strandlake.operators import sketchset
from strandlake.streaming import accumulate

SPEC = HashSpec(k=9, w=3)


def write_parts(spark, folder, n):
    rng = random.Random(13)
    rows = [(random_dna(rng, 120),) for _ in range(60)]
    spark.createDataFrame(rows, "seq string").repartition(n).write.parquet(str(folder))


def test_running_counts(spark, tmp_path):
    write_parts(spark, tmp_path / "in", 3)
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = accumulate.running_counts(stream, spec=SPEC).writeStream.outputMode("complete").format(
        "memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    batch = sketchset.count_sequences(spark.read.parquet(str(tmp_path / "in")), spec=SPEC)
    assert sorted(map(tuple, spark.sql("select * from counts").collect())) == sorted(
        (r["hash"], r["depth"]) for r in batch.collect())


def test_accumulated_sets(spark, tmp_path):
    write_parts(spark, tmp_path / "in", 3)
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = accumulate.start_accumulating(stream, str(tmp_path / "out"), str(tmp_path / "cp"), spec=SPEC)
    query.awaitTermination()
    batch = sketchset.count_sequences(spark.read.parquet(str(tmp_path / "in")), spec=SPEC)
    got = accumulate.load_accumulated(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
