from pyspark.sql import functions as F

from corpusloom.plans import corpus_queries, stages
from corpusloom.streaming import rows


def test_stages_add_up(spark, data):
    sf = f"{data}/sf0.001"
    raw = corpus_queries.pairs(spark, sf)
    total = raw.count()
    filtered = stages.filter_stage(raw.select(F.col("row_id").alias("row_index"), "ESP", "SHIWILU")).summary()
    assert filtered["valid_rows"][0]["n"] + filtered["removed_rows"][0]["n"] == total == filtered["valid_rows"][0]["n"] + sum(r["count"] for r in filtered["reasons"])
    unified = stages.unify_stage(corpus_queries.unified(spark, sf))
    assert sum(r["count"] for r in unified.summary()["sources"]) == unified.frames["unified"].count()
    norm = stages.normalize_stage(corpus_queries.identified(spark, sf))
    s = norm.summary()
    assert sum(r["count"] for r in s["by_rule"]) == sum(r["count"] for r in s["by_column"]) == s["changes"][0]["transformations"] and norm.frames["removed"].count() == 0
    checked = stages.audit_stage(norm.frames["normalized"].persist())
    flagged = checked.frames["final"].filter("has_audit_flags").count()
    assert flagged == checked.frames["problems"].count() and checked.frames["final"].count() == total
    assert "== by_type" in checked.report()
    items = stages.extract_stage(corpus_queries.labelled_lines(spark, sf))
    assert sum(r["n"] for r in items.summary()["quality"]) == items.frames["pairs"].count()
    scores = stages.compare_stage(corpus_queries.scores(spark, sf), "vec_id").summary()
    assert abs(scores["distribution"][0]["median"] - scores["percentiles"][2]["value"]) < 1e-12


def test_streamed_rows_equal_batch_rows(spark, data, tmp_path):
    batch = corpus_queries.identified(spark, f"{data}/sf0.001")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    log = rows.normalized(rows.judged(stream).filter("removal_reason is null"))[1]
    q = log.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = rows.normalized(rows.judged(batch).filter(F.col("removal_reason").isNull()))[1]
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(want.columns).collect())) == sorted(map(str, want.collect()))
