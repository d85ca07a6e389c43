"""Bottom-k fingerprints of word shingles, in DataFrame functions only.

A fingerprint is the sorted list of the K smallest distinct hashes of a text's shingles of SHINGLE words (A-Z in lower
case). Fingerprints of parts merge to that of the whole, and estimate resemblance, containment and the number of distinct
shingles; where both texts have fewer than K shingles the figures are exact. Texts of any length are read whole.

Defined results: null texts are empty; a text of fewer words than a shingle has the whole sequence as its only one; an
empty fingerprint resembles an empty one by 1 and any other by 0. Repeated rows each give their row. In the order of
documents null ids come last, and equal ids follow each other by a hash of their texts. Columns other than doc_id and text are
left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP_SQL, sql_ascii_lower

K, SHINGLE = 256, 5
_TOP = float(1 << 63)


def add_sketch(df: DataFrame, text: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint of a text column as array<long>."""
    words, hashes = f"_{out}_words", f"_{out}_hashes"
    df = df.withColumn(words, F.array_remove(F.split(sql_ascii_lower(F.coalesce(F.col(text), F.lit(""))), GAP_SQL), ""))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    each = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (shingle - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + n) for n in range(1, shingle)]))
    whole = F.array(F.xxhash64(F.array_join(words, " ")))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(f"_{out}_all", F.when(F.size(words) >= shingle, each).when(F.size(words) > 0, whole).otherwise(none))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(f"_{out}_all")), 1, k)).drop(words, hashes, f"_{out}_all")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(df: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """key and the fingerprint of all its rows; each task hands on only the k smallest hashes of a key."""
    rows = df.select(key, F.explode(sketch).alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("h"))
    least = rows.withColumn("rank", rank).where(F.col("rank") <= k).groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))
    return df.select(key).distinct().join(least, key, "left").withColumn(sketch, F.coalesce(sketch, F.array().cast("array<bigint>")))


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated share of the distinct shingles of either text that both have."""
    both = F.array_union(a, b)
    exact = (F.size(a) < k) & (F.size(b) < k)
    union = F.when(exact, both).otherwise(F.slice(F.sort_array(both), 1, k))
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(union))


def distinct_shingles(sketch: str, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    last = (F.element_at(sketch, -1).cast("double") + _TOP) / (2 * _TOP)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / last)


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of the distinct shingles of a that b has: of those hashes of a that both fingerprints would show.

    Where there is none, from the resemblance.
    """
    last = lambda s: F.when(F.size(s) >= k, F.element_at(s, -1)).otherwise(F.lit((1 << 63) - 1))
    seen = F.filter(a, lambda h: h <= F.least(last(a), last(b)))
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    rough = F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(seen) == 0, rough).otherwise(F.size(F.array_intersect(seen, b)) / F.size(seen))


def as_text(sketch: str) -> Column:
    """The fingerprint as hexadecimal digits, 16 for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def with_next(docs: DataFrame, columns: list[str], finish) -> DataFrame:
    """Gives finish() the rows, cut into ranges of doc_id, and a function that reads a column of the next document.

    The next document is that of the next smaller doc_id; after the smallest comes the largest. Ranges are cut at
    approximate quantiles, one for each shuffle partition; the largest row of a range is also sent to the next range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(*columns).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("_tie", F.xxhash64("text"))
    cuts = base.agg(F.percentile_approx("_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 10 * parts))).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    base = base.withColumn("_part", F.size(F.filter(bounds, lambda c: c < F.col("_id"))))
    largest = {r["_part"]: r["top"] for r in base.groupBy("_part").agg(F.max("_id").alias("top")).collect()}
    order = sorted(largest)
    follower = dict(zip(order, order[1:] + order[:1], strict=True))
    tops = F.array(*[F.lit(largest.get(p)).cast("long") for p in range(len(cuts) + 1)])
    nexts = F.array(*[F.lit(follower.get(p)).cast("int") for p in range(len(cuts) + 1)])
    own = F.struct(F.col("_part").alias("to"), F.lit(False).alias("carried"))
    carry = F.struct(F.get(nexts, F.col("_part")).alias("to"), F.lit(True).alias("carried"))
    copies = F.when(F.col("_id") == F.get(tops, F.col("_part")), F.array(own, carry)).otherwise(F.array(own))
    rows = base.withColumn("_copy", F.explode(copies)).withColumn("_to", F.col("_copy.to")).withColumn("_carried", F.col("_copy.carried")).drop("_copy", "_part")
    window = Window.partitionBy("_to").orderBy(F.desc("_carried"), "_id", "_tie")
    out = finish(rows, lambda column: F.lag(column).over(window))
    return out.where("not _carried").drop("_to", "_carried", "_id", "_tie")


def compare_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is replaced by the start of the next document."""

    def finish(rows: DataFrame, following) -> DataFrame:
        rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_chars", F.length("text").cast("long"))
        rows = rows.withColumn("_next", following("text"))
        keep = (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")
        rows = rows.withColumn("_edited", F.concat(F.substring("text", F.lit(1), keep), F.substring("_next", F.lit(1), F.col("n_chars").cast("int") - keep))).drop("_next")
        rows = add_sketch(rows, "text", "_a", k).drop("text")
        rows = add_sketch(rows.withColumn("edited_sha256", F.sha2("_edited", 256)), "_edited", "_b", k).drop("_edited")
        return rows.withColumn("_c", following("_a"))

    out = with_next(docs, ["doc_id", "text"], finish)
    return out.select("doc_id", "n_chars", "edited_sha256", as_text("_a").alias("fingerprint"), as_text("_b").alias("edited_fingerprint"), resemblance("_a", "_b", k).alias("near_edited"), resemblance("_a", "_c", k).alias("near_next"), F.round(distinct_shingles("_a", k), 3).alias("n_shingles"), F.round(containment("_a", "_b", k), 6).alias("kept_in_edited"))
