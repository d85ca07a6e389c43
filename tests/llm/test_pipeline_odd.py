"""Odd rows that come as far as the last stages: copies without an id, repeated rows, empty and blank texts, clashing columns."""

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_copies_and_blanks_change_nothing(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    some = docs.where(F.col("doc_id").isin(sorted({r[0] for r in want})[:3]))
    odd = spark.createDataFrame([(10**7, "", "en", "s", 0), (10**7 + 1, " \n\t", "de", "s", 3), (10**7 + 2, None, None, None, None), (None, None, None, None, None), (None, "", "en", None, 0)], docs.schema)
    more = docs.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd)
    clash = more.withColumns({c: F.lit(c) for c in ("kept", "run", "part", "fp", "row", "copy", "stratum", "block", "piece", "length")})
    clash.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and want
