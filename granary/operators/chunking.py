"""Chunkers: a document becomes rows (doc_id, chunk_index, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def fixed(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of size characters; one starts every size - overlap as long as the one before doesn't reach the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller than size")
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(size - overlap))
    cut = F.filter(F.transform(starts, lambda s: T.trim(F.substring("text", s + 1, F.lit(size)))), lambda c: c != "")
    return docs.where("text is not null").select("doc_id", F.posexplode(cut).alias("chunk_index", "text"))


def newline(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Lines merged up to size characters, with up to overlap characters carried over; longer lines stay whole."""

    def fold(state: Column, line: Column) -> Column:
        length = F.length(line)
        joined = lambda lines: F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x)) + F.greatest(F.size(lines) - 1, F.lit(0))
        full = (F.size(state["held"]) > 0) & (state["total"] + length + 1 > size)
        # the longest tail of the held lines that is short enough to be carried and leaves room for the line
        tails = F.transform(F.sequence(F.lit(0), F.size(state["held"])), lambda k: F.slice(state["held"], k + 1, F.size(state["held"])))
        fits = F.filter(tails, lambda t: (F.size(t) == 0) | ((joined(t) <= overlap) & (joined(t) + length + 1 <= size)))
        carried = F.element_at(fits, 1)
        held = F.when(full, F.concat(carried, F.array(line))).otherwise(F.concat(state["held"], F.array(line)))
        done = F.when(full, F.concat(state["done"], F.array(F.array_join(state["held"], "\n")))).otherwise(state["done"])
        return F.struct(done.alias("done"), held.alias("held"), joined(held).alias("total"))

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("held"), F.lit(0).alias("total"))
    lines = F.filter(F.split("text", "\n"), lambda s: s != "")
    folded = docs.where("text is not null").select("doc_id", F.aggregate(lines, start, fold).alias("s"))
    last = F.when(F.size("s.held") > 0, F.array(F.array_join("s.held", "\n"))).otherwise(none)
    chunks = F.filter(F.transform(F.concat("s.done", last), T.trim), lambda c: c != "")
    return folded.select("doc_id", F.posexplode(chunks).alias("chunk_index", "text"))


def fold_ranges(n: Column, breaks: Column, most: int, least: int, overlap: int) -> Column:
    """Ranges of sentence numbers: one closes when it has `most` sentences, or `least` and a break; `overlap` are carried."""

    def step(state: Column, i: Column) -> Column:
        size = state["size"] + 1
        closes = (size >= most) | (F.array_contains(breaks, i) & (size >= least))
        ranges = F.when(closes, F.concat(state["ranges"], F.array(F.struct((i - size + 1).alias("begin"), i.alias("end"))))).otherwise(state["ranges"])
        return F.struct(F.when(closes, F.least(F.lit(overlap), size)).otherwise(size).alias("size"), ranges.alias("ranges"))

    start = F.struct(F.lit(0).alias("size"), F.array().cast("array<struct<begin:int,end:int>>").alias("ranges"))
    folded = F.aggregate(F.sequence(F.lit(0), n - 1), start, step)
    rest = F.filter(F.array(F.struct((n - folded["size"]).cast("int").alias("begin"), (n - 1).cast("int").alias("end"))), lambda r: r["begin"] <= r["end"])
    return F.concat(folded["ranges"], rest)


def sentence_gaps(vectors: DataFrame, group: str, order: str, vector: str = "embedding") -> DataFrame:
    """Cosine of each vector of a group to the one before it."""
    from pyspark.sql import Window

    before = F.lag(vector).over(Window.partitionBy(group).orderBy(order))
    return vectors.withColumn("_before", before).where("_before is not null").select(group, order, F.round(T.cosine(F.col("_before"), F.col(vector)), 6).alias("sim"))


def semantic_ranges(vectors: DataFrame, group: str, order: str, percentile: float = 0.7, most: int = 8, overlap: int = 2) -> DataFrame:
    """Ranges of sentences of a group, broken where neighbours are at most as alike as the percentile of the group."""
    gaps = sentence_gaps(vectors, group, order)
    cut = gaps.groupBy(group).agg(F.expr(f"percentile(sim, {percentile})").alias("threshold"), F.sort_array(F.collect_list(F.struct(order, "sim"))).alias("gaps"))
    breaks = F.filter(F.transform("gaps", lambda g, i: F.when(g["sim"] <= F.col("threshold"), i)), lambda i: i.isNotNull())
    ranges = cut.withColumn("breaks", breaks).select(group, F.posexplode(fold_ranges(F.size("gaps") + 1, F.col("breaks"), most, 2, overlap)).alias("chunk_index", "r"))
    return ranges.select(group, "chunk_index", F.col("r.begin").alias("first"), F.col("r.end").alias("last"))


def normal_breaks(breaks: Column, n: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(breaks, lambda b: (b >= 0) & (b < n - 1))))


def fallback_breaks(n: Column, every: int = 6) -> Column:
    return F.when(n > every, F.sequence(F.lit(every - 1), F.greatest(n - 2, F.lit(every - 1)), F.lit(every))).otherwise(F.array().cast("array<int>"))


def enforced_breaks(breaks: Column, n: Column, least: int = 2, most: int = 6) -> Column:
    """Breaks that leave no chunk under `least` sentences, and more of them where one has over `most`."""
    none = F.array().cast("array<int>")

    def apart(state: Column, b: Column) -> Column:
        ok = (b - state["last"] >= least) & (n - 1 - b >= 1)
        return F.struct(F.when(ok, b).otherwise(state["last"]).alias("last"), F.when(ok, F.concat(state["kept"], F.array(b))).otherwise(state["kept"]).alias("kept"))

    first = F.aggregate(normal_breaks(breaks, n), F.struct(F.lit(-1).alias("last"), none.alias("kept")), apart)["kept"]

    def capped(state: Column, b: Column) -> Column:
        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil((b - state["last"]) / most).cast("int")))
        more = F.filter(F.transform(steps, lambda k: state["last"] + k * most), lambda x: x < b)
        real = F.when(b < n - 1, F.array(b)).otherwise(none)
        return F.struct(b.alias("last"), F.concat(state["kept"], more, real).alias("kept"))

    out = F.aggregate(F.concat(first, F.array((n - 1).cast("int"))), F.struct(F.lit(-1).alias("last"), none.alias("kept")), capped)["kept"]
    return F.when(F.size(out) == 0, fallback_breaks(n)).otherwise(out)


def from_breaks(docs: DataFrame, breaks: Column, small: int = 6) -> DataFrame:
    """Chunks that end at the breaks; each starts with the last sentence of the one before. docs has doc_id, sentences."""
    n = F.size("sentences")
    ends = F.when(n <= small, F.array(n - 1)).otherwise(F.concat(breaks, F.array(n - 1)))
    df = docs.where(n > 0).withColumn("ends", ends.cast("array<int>"))
    begins = F.transform("ends", lambda e, i: F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1)))
    df = df.withColumn("begins", begins).select("doc_id", "sentences", F.posexplode(F.arrays_zip("begins", "ends")).alias("chunk_index", "r"))
    part = F.slice("sentences", F.col("r.begins") + 1, F.col("r.ends") - F.col("r.begins") + 1)
    return df.select("doc_id", "chunk_index", F.size(part).alias("n_sent"), F.array_join(part, " ").alias("text"))


def window_breaks(sentences: Column, planner, size: int = 80, overlap: int = 10, to_end: bool = False) -> Column:
    """Breaks that a planner (Column of sentences -> Column of breaks) proposes window by window, as sentence numbers.

    A window starts every size - overlap sentences; the last one is that which reaches the end, or, if to_end is set, the
    last one that has a sentence. What a planner proposes outside its window counts for nothing.
    """
    n, step = F.size(sentences), size - overlap
    last = F.greatest(n - 1, F.lit(0)) if to_end else F.greatest(n - 1 - overlap, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(step))
    found = F.transform(starts, lambda s: F.transform(F.filter(planner(F.slice(sentences, s + 1, F.lit(size))), lambda b: (b >= 0) & (b < F.least(n - s, F.lit(size)))), lambda b: s + b))
    return F.array_sort(F.array_distinct(F.flatten(found)))


def _joined(docs: DataFrame, ranges: Column, least: int) -> DataFrame:
    """Chunks of ranges of sentences; documents of fewer sentences than `least` stay as they are. docs has doc_id, text, sentences."""
    cut = F.transform(ranges, lambda r: F.array_join(F.slice("sentences", r["begin"] + 1, r["end"] - r["begin"] + 1), " "))
    chunks = F.when(F.size("sentences") < least, F.array("text")).otherwise(cut)
    return docs.select("doc_id", F.posexplode(chunks).alias("chunk_index", "text"))


def agentic_eval(docs: DataFrame, planner, most: int = 6, least: int = 2, overlap: int = 1, size: int = 80, window_overlap: int = 10) -> DataFrame:
    """Chunks closed by a planner's break or at `most` sentences, carried ones included; no fallback, texts of up to two sentences stay whole."""
    df = docs.where("text is not null").select("doc_id", "text", T.sentences(F.col("text")).alias("sentences"))
    df = df.withColumn("breaks", window_breaks(F.col("sentences"), planner, size, window_overlap, to_end=True))
    return _joined(df, T.once(F.col("breaks"), lambda b: fold_ranges(F.size("sentences"), b, most, least, overlap)), 3)


def semantic(docs: DataFrame, prepare, likeness, percentile: float = 0.7, most: int = 8, overlap: int = 2) -> DataFrame:
    """Chunks broken where neighbouring sentences are at most as alike as the percentile within the document.

    prepare makes of a sentence what likeness compares, e.g. providers.hashed_embedding and text.cosine, or text.tokens and
    text.jaccard. Texts of up to one sentence stay whole.
    """
    df = docs.where("text is not null").select("doc_id", "text", T.sentences(F.col("text")).alias("sentences"))
    df = df.withColumn("ready", F.transform("sentences", prepare))
    pairs = F.sequence(F.lit(0), F.greatest(F.size("ready") - 2, F.lit(0)))
    df = df.withColumn("sims", F.transform(pairs, lambda i: F.round(likeness(F.get("ready", i), F.get("ready", i + 1)), 6)))
    df = df.withColumn("cut", F.round(T.array_percentile(F.col("sims"), percentile), 9))
    breaks = T.once(F.col("cut"), lambda cut: F.filter(F.transform("sims", lambda s, i: F.when(s <= cut, i)), lambda i: i.isNotNull()))
    df = df.withColumn("breaks", breaks)
    return _joined(df, T.once(F.col("breaks"), lambda b: fold_ranges(F.size("sentences"), b, most, 2, overlap)), 2)


def planned(docs: DataFrame, planner=None, small: int = 6) -> DataFrame:
    """Chunks at the breaks that a planner proposes window by window; none: after every sixth sentence.

    A window of up to `small` sentences isn't asked about, and its last sentence is no break.
    """
    df = docs.select("doc_id", T.sentences(F.col("text")).alias("sentences"))
    n = F.size("sentences")
    if planner is None:
        return from_breaks(df, fallback_breaks(n))
    asked = lambda s: F.when(F.size(s) <= small, F.array().cast("array<int>")).otherwise(normal_breaks(planner(s), F.size(s)))
    df = df.withColumn("plan", normal_breaks(window_breaks(F.col("sentences"), asked), n))
    return from_breaks(df, F.when(F.size("plan") == 0, fallback_breaks(n)).otherwise(enforced_breaks(F.col("plan"), n)))
