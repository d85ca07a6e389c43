"""Sources and sinks: document folders, test sets, tables kept between runs, and result files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """source and text of every non-empty .md file of a folder; raises if there is none."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    out = files.select(F.col("_metadata.file_name").alias("source"), T.trim(F.col("value")).alias("text")).where("text <> ''")
    if out.isEmpty():
        raise ValueError(f"no documents with text in {folder}")
    return out


def test_set(spark: SparkSession, path: str) -> DataFrame:
    """query, reference_answer and source of a JSON list; raises if it is empty."""
    out = spark.read.schema("query string, reference_answer string, source string").json(path, multiLine=True)
    out = out.where("coalesce(query, '') <> ''")
    if out.isEmpty():
        raise ValueError(f"no queries in {path}")
    return out


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def keep(df: DataFrame, path: str, rebuild: bool = False, partition: str | None = None) -> DataFrame:
    """The table at path; written from df first if it isn't there or is empty, or a rebuild is asked for."""
    rebuild = rebuild or not count_rows(df.sparkSession, path)
    writer = df.write.mode("overwrite" if rebuild else "ignore")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def open_existing(spark: SparkSession, path: str) -> DataFrame:
    """The table at path; raises if it isn't there or is empty."""
    out = spark.read.parquet(path)
    if out.isEmpty():
        raise ValueError(f"no rows in {path}")
    return out


def chunk_rows(df: DataFrame, method: str) -> DataFrame:
    """Chunks with source and chunk_index filled in, blank ones left out.

    Where chunk_index is missing or no number, a chunk gets the number after the source's highest, in order of the text.
    """
    kept = df.where(F.coalesce(T.trim(F.col("text")), F.lit("")) != "").withColumn("source", F.coalesce("source", F.lit("unknown")))
    kept = kept.withColumn("chunk_index", F.expr("try_cast(chunk_index as int)"))
    known, unknown = kept.where("chunk_index is not null"), kept.where("chunk_index is null")
    top = known.groupBy("source").agg(F.max("chunk_index").alias("_top"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("text"))
    numbered = unknown.join(top, "source", "left").withColumn("chunk_index", F.coalesce("_top", F.lit(-1)) + place)
    return known.unionByName(numbered.select(*known.columns)).withColumn("chunk_method", F.lit(method))


def add_rows(df: DataFrame, path: str) -> int:
    """Adds rows to a kept table and gives the number that it has then; raises if that isn't the sum."""
    spark = df.sparkSession
    before, n = count_rows(spark, path), df.count()
    df.write.mode("append").parquet(path)
    after = count_rows(spark, path)
    if after != before + n:
        raise ValueError(f"{path} has {after} rows in place of {before + n}")
    return after


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a kept table; 0 if there is none."""
    try:
        return spark.read.parquet(path).count()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0


def setting(name: str, given: dict, environment: dict, default=None):
    """What a caller gave, else what the environment says, else the default; empty strings count as nothing."""
    for source in (given, environment):
        if source.get(name) not in (None, ""):
            return source[name]
    return default


def flag(name: str, given: dict, environment: dict, default: bool | None = None) -> bool | None:
    """A setting as true or false, however it is written; anything else is the default."""
    said = str(setting(name, given, environment, "")).strip().lower()
    return True if said in ("1", "true", "t", "yes", "y", "on") else False if said in ("0", "false", "f", "no", "n", "off") else default


def env_file(text: str) -> dict[str, str]:
    """NAME=value lines of an .env file; quotes around a value go, comments and other lines are left out."""
    out = {}
    for line in text.splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and name.strip() and not name.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            out[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].strip()
    return out


def write_results(df: DataFrame, path: str, label: str, metrics: list[str]) -> None:
    """A CSV of labels and metrics with six decimals, sorted by label; missing metrics are 0."""
    fixed: list[Column] = [F.format_string("%.6f", F.coalesce(F.col(m).cast("double"), F.lit(0.0))).alias(m) for m in metrics]
    df.select(label, *fixed).orderBy(label).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(f"{path}.json")
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(f"{path}.csv", header=True)


def merge_results(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; the newer value of a column wins."""
    names = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    pick = [F.coalesce(*[d[c] for d in (new, old) if c in d.columns]).alias(c) for c in names]
    return old.join(new, old[key] == new[key], "full").select(F.coalesce(new[key], old[key]).alias(key), *pick)


def usable_questions(rows: DataFrame) -> DataFrame:
    """Question rows with question and answer, of the open subset or none; evidence becomes its sorted document names.

    rows: question, answer, dataset_subset_label, evidence (array of structs of doc_name and evidence_doc_name), and any other
    columns; of these, null strings become empty.
    """
    text = lambda c: F.coalesce(T.trim(F.col(c)), F.lit(""))
    kept = rows.withColumns({c: text(c) for c in ("question", "answer")}).where("question <> '' and answer <> ''")
    kept = kept.where("coalesce(dataset_subset_label, '') in ('', 'OPEN_SOURCE')")
    names = F.transform("evidence", lambda e: T.trim(F.coalesce(F.nullif(e["doc_name"], F.lit("")), e["evidence_doc_name"], F.lit(""))))
    kept = kept.withColumn("evidence_doc_names", F.coalesce(F.array_sort(F.array_distinct(F.filter(names, lambda x: x != ""))), F.array().cast("array<string>")))
    return kept.drop("evidence").na.fill("", [c for c, t in rows.dtypes if t == "string"])


def eval_examples(items: DataFrame) -> DataFrame:
    """inputs, outputs and metadata of every item (query, reference_answer, source) that has a query."""
    has = items.where("coalesce(query, '') <> ''")
    return has.select(F.struct("query").alias("inputs"), F.struct(F.coalesce("reference_answer", F.lit("")).alias("reference_answer")).alias("outputs"), F.struct(F.coalesce("source", F.lit("")).alias("source")).alias("metadata"))


def sample(rows: DataFrame, key: str, size: int, seed: int = 42, order: Column | None = None) -> DataFrame:
    """A seeded sample without replacement, sorted by key; raises if there are too few rows. order: in place of a hash of the key."""
    out = rows.orderBy(F.xxhash64(F.lit(seed), key) if order is None else order, key).limit(size)
    if (n := out.count()) < size:
        raise ValueError(f"{size} rows were asked for, there are {n}")
    return out.orderBy(key)


def sorted_results(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows by the columns, nulls like empty strings."""
    return rows.orderBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
