"""What a search of the ledger shuffles grows with its rows alone."""

from pyspark.sql import functions as F

from posterboard.operators import memory


def test_a_hash_is_no_more_rows_than_bands(spark):
    """No plan of the image check lists the codes around a hash, of which there were 1,108."""
    rows = spark.range(50).select(F.col("id").cast("string").alias("fingerprint"), F.lpad(F.hex("id"), 16, "0").alias("flyer_phash"), F.lit(None).cast("date").alias("start_date"), F.array().cast("array<string>").alias("warnings"))
    out = memory.judge_image_twins(rows, rows.select("fingerprint", F.col("flyer_phash").alias("phash"), "start_date"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "transform([" not in plan and "lambdafunction(named_struct(band" not in plan and "lambdafunction(struct(band" not in plan
    assert {r.image_verdict for r in out.collect()} == {"drop"}
