"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import scratch

#: White space of the word rule: a word is a run of anything else.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that a broadcast side may have, by its counted rows; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Rows and bytes of a batch that goes to Python.
BATCH, BATCH_BYTES = 512, 4 << 20
#: A key with over a SPREAD-th of all rows is hot; so there are SPREAD hot keys at most.
SPREAD = 1000

#: DuckDB SQL: the table of crc32, made from its polynomial, as one row crc_table (t).
CRC_SQL = """
crc_table AS MATERIALIZED (
    SELECT list(list_reduce([b, 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t
    FROM (SELECT range::BIGINT AS b FROM range(256))
)"""

#: The folders that were written so far, in order.
MADE: list[str] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that nobody reads any more."""
    for x in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, its session handing rows to Python in batches of BATCH rows and BATCH_BYTES at most, so that long texts don't fill the workers and the buffers that
    the JVM keeps beside its heap."""
    for name, most in (("maxRecordsPerBatch", BATCH), ("maxBytesPerBatch", BATCH_BYTES)):
        if df.sparkSession.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:  # what a session sets itself stays
            df.sparkSession.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes, beside crc_table."""
    each = f"list_transform(range(1, length(hex({text})), 2), lambda i: ('0x' || substr(hex({text}), i, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295)"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text in order; none for null, empty or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def n_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def row_of(docs: DataFrame) -> Column:
    """All columns of docs as one struct, beside which an operator's own columns can't clash with any; `row.*` gives them back."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")


def fenced(df: DataFrame) -> DataFrame:
    """df, through a generator of one row each: filters above it stay above it, so that Spark doesn't write the columns that they read, with all
    that those need, once more into the filter."""
    return df.select(F.inline_outer(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def within(df: DataFrame, row_bytes: int) -> bool:
    """Whether df may be broadcast: its rows, counted, of row_bytes each."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def hinted(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint where its counted size allows it."""
    return F.broadcast(df) if within(df, row_bytes) else df


def spread_join(left: DataFrame, right: DataFrame, on: list[str], n: str) -> DataFrame:
    """left.join(right, on), for a right side with one row per key and in column n how many rows left has of that key. The hot keys, those with over a
    SPREAD-th of all rows, are broadcast, SPREAD rows at most, so that their rows of left stay where they are; all others are shuffled."""
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = right.where(F.col(n) * SPREAD > total)
    if total < SPREAD or hot.isEmpty():
        return left.join(right, on)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(n) * SPREAD <= total), on)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def sized_join(left: DataFrame, right: DataFrame, on: list[str], n: str, row_bytes: int) -> DataFrame:
    """spread_join, or a broadcast of right where its counted size allows it."""
    return left.join(F.broadcast(right), on) if within(right, row_bytes) else spread_join(left, right, on, n)


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with one row of each group. found, written, has a row for each of docs: id, h (xxhash64 of the text) and root, the same
    for all of a group. The row with the smallest id and then text hash stays, null ids last; of rows with the same id and text, one."""
    order = F.struct(F.col("id").isNull(), "id", "h")
    kept = found.groupBy("root").agg(F.min_by(F.struct("id", "h"), order).alias("x")).select(F.col("x.id").alias("i"), F.col("x.h").alias("t"))
    per = found.groupBy("id", "h").agg(F.count("*").alias("m"))
    marked = written(per.join(kept, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("t")), "left"), "kept")
    gone = hinted(marked.where("t IS NULL").select("id", "h"), 40)
    twice = hinted(marked.where("t IS NOT NULL AND m > 1").select("id", "h"), 40)

    def same(these: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(these["id"]) & (F.xxhash64(docs["text"]) == these["h"])

    own = docs.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return own
    again = docs.join(twice, same(twice), "left_semi")
    order = Window.partitionBy("row.doc_id", F.xxhash64("row.text")).orderBy(F.xxhash64(F.to_json("row")))
    first = again.select(row_of(again)).withColumn("r", F.row_number().over(order)).where("r = 1").select("row.*")
    return own.join(twice, same(twice), "left_anti").unionByName(first)
