"""What fingerprints estimate, against the sets of shingles themselves."""

import re

import pytest
from pyspark.sql import functions as F

from granary.llm import queries, sketches

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text: str) -> set[str]:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)} - {""}


def text(n: int, start: int = 0) -> str:
    return " ".join(f"w{start + i}" for i in range(n))


@pytest.fixture(scope="module")
def sketched(spark):
    texts = [text(3000), text(3000, 1500), text(40), text(60, 10), text(3), "", None, text(2000, 9000), text(3000) + " " + text(2000, 9000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return texts, sketches.add_sketch(df, "text", "s")


def pair(sketched, a, b):
    _, df = sketched
    both = df.where(F.col("doc_id") == a).select(F.col("s").alias("a")).crossJoin(df.where(F.col("doc_id") == b).select(F.col("s").alias("b")))
    return both.select(sketches.resemblance("a", "b").alias("r"), sketches.containment("a", "b").alias("c"), sketches.distinct_shingles("a").alias("n"), sketches.merged(F.col("a"), F.col("b")).alias("m")).first()


@pytest.mark.parametrize(("a", "b"), [(0, 1), (0, 8), (7, 8), (8, 7), (2, 3), (4, 2), (5, 5), (5, 2), (6, 5), (2, 5), (2, 0)])
def test_estimates(sketched, a, b):
    texts, _ = sketched
    x, y = shingles(texts[a]), shingles(texts[b])
    got, exact = pair(sketched, a, b), len(x) < sketches.K and len(y) < sketches.K
    room = 1e-9 if exact else 0.1
    assert abs(got["r"] - (len(x & y) / len(x | y) if x | y else 1.0)) <= room
    assert abs(got["c"] - (len(x & y) / len(x) if x else 1.0)) <= room
    assert abs(got["n"] - len(x)) <= (1e-9 if len(x) < sketches.K else 0.2 * len(x))


def test_parts_merge_to_the_whole(sketched, spark):
    _, df = sketched
    rows = df.collect()
    whole = lambda ids: sorted(set().union(*(r["s"] for r in rows if r["doc_id"] in ids)))[: sketches.K]
    assert pair(sketched, 0, 1)["m"] == whole({0, 1})
    grouped = {r["k"]: r["s"] for r in sketches.merge_by(df.withColumn("k", F.col("doc_id") % 3), "k", "s").collect()}
    assert grouped == {k: whole({i for i in range(9) if i % 3 == k}) for k in range(3)}


def test_query_has_the_estimates(spark):
    for r in queries.op4_fingerprints(spark, "/root/testdata/sf0.001").collect():
        assert r["n_shingles"] >= 0 and 0 <= r["kept_in_edited"] <= 1 and (r["near_edited"] < 1 or r["kept_in_edited"] == 1)
        assert len(r["fingerprint"]) % 16 == 0 and (len(r["fingerprint"]) // 16 == sketches.K or len(r["fingerprint"]) // 16 == r["n_shingles"])
