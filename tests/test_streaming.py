from strandlake.operators import reads as R
from strandlake.sources import derive
from strandlake.streaming import reads as S


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    batch = derive.reads(spark, sf_dir)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    S.run_once(S.trimmed_sample(stream, 2, 9, 0.5), "trimmed", "append", str(tmp_path / "c1"))
    expected = R.trim(R.sample_fraction(R.only_acgtn(batch), 0.5), 2, 9)
    assert sorted(map(tuple, spark.table("trimmed").collect())) == sorted(map(tuple, expected.collect()))
    S.run_once(S.running_summary(stream), "summary", "complete", str(tmp_path / "c2"))
    assert spark.table("summary").count() == 3


def test_event_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "user_id")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    S.run_once(S.windowed_counts(stream, width="1 day", by="event_type"), "windows", "complete", str(tmp_path / "c1"))
    assert spark.table("windows").groupBy().sum("n").first()[0] == events.count()
    S.run_once(S.first_seen(stream, delay="3650 days", key="user_id"), "firsts", "append", str(tmp_path / "c2"))
    assert spark.table("firsts").count() == events.select("user_id").distinct().count()


def test_appended_rows_stay_out_of_the_driver(spark, sf_dir, tmp_path):
    batch = derive.reads(spark, sf_dir)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for n in (1, 2):  # a second run on the checkpoint takes only what is new
        S.run_once(R.only_acgtn(stream), "kept", "append", str(tmp_path / "c"))
        plan = spark.table("kept")._jdf.queryExecution().optimizedPlan().toString()
        assert "MemoryPlan" not in plan and "Relation" in plan
        assert spark.table("kept").count() == n * R.only_acgtn(batch).count()
        batch.write.mode("append").parquet(str(tmp_path / "in"))
    S.run_once(stream.where("false"), "none", "append", str(tmp_path / "d"))
    assert spark.table("none").count() == 0 and spark.table("none").columns == batch.columns
