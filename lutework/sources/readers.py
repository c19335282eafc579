"""Readers of exported scores, predictions and tables, each a declared scan whose rows Spark splits over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The keys under which exports keep their list of records, in order of precedence.
LIST_KEYS = ["data", "list", "records", "rows", "items", "result"]
CORRUPT = "_corrupt"


def _in_file_order(df: DataFrame) -> DataFrame:
    """Adds file_order, which sorts as the lines stand in the files: file, split of the file, and row of the split."""
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn("file_order", order)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line, with file_order. A line that isn't an object, such as a last one that was cut off, is left out."""
    read = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    # Spark parses nothing where only the corrupt column is asked for, so the order column is taken along
    return _in_file_order(read).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def latest_json_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Of the lines with one key, the last; lines without the key are left out. The rule of append-only checkpoints, too."""
    rows = json_lines(spark, path, schema).where(F.col(key).isNotNull())
    rest = [c for c in rows.columns if c not in (key, "file_order")]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("file_order")).alias("row"))
    return best.select(key, "row.*")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file, over as many lines as it takes."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns text; a byte order mark before the first name is taken off."""
    read = spark.read.option("header", True).csv(path)
    return read.toDF(*[c.lstrip("﻿") for c in read.columns])


def markdown_rows(spark: SparkSession, path: str, n_columns: int) -> DataFrame:
    """Rows of Markdown tables whose first cell is a number: file, number and cells (n_columns in all, the first included)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(c))
    return (
        lines.where(F.col("line").rlike(r"^\|\s*\d+\s*\|")).select("file", cells.alias("cells"))
        .where(F.size("cells") == n_columns).select("file", F.col("cells")[0].cast("long").alias("number"), "cells")
    )


def sniffed_records(documents: DataFrame, text: str, id_key: str, name_key: str) -> DataFrame:
    """Of documents with a JSON text, the records of the first list that is found under LIST_KEYS, or of a bare list: record (JSON), id and
    name. A record must have both; anything else is left out."""
    whole = F.try_parse_json(text)
    listed = F.coalesce(
        F.try_variant_get(whole, "$", "array<variant>"), *[F.try_variant_get(whole, f"$.{k}", "array<variant>") for k in LIST_KEYS],
        *[F.try_variant_get(whole, f"$.data.{k}", "array<variant>") for k in LIST_KEYS],
    )
    each = documents.select("*", F.explode_outer(listed).alias("__r"))
    found = each.select(
        *documents.columns, F.to_json("__r").alias("record"), F.try_variant_get("__r", f"$.{id_key}", "string").alias("id"),
        F.try_variant_get("__r", f"$.{name_key}", "string").alias("name"),
    )
    return found.where("id IS NOT NULL AND name IS NOT NULL")


def lexicon(entries: DataFrame, term: str, aliases: str, category: str) -> DataFrame:
    """Aliases (parted by /, 、 or a comma) as rows: alias, term and category. Of equal aliases the entry that comes first by category
    and term stays; length is for longest-first matching."""
    alias = F.explode(F.array_distinct(F.concat(F.array(F.col(term)), F.split(F.coalesce(F.col(aliases), F.lit("")), "[/、,，]"))))
    rows = entries.select(alias.alias("alias"), F.col(term).alias("term"), F.col(category).alias("category")).withColumn("alias", F.trim("alias")).where("alias <> ''")
    best = rows.groupBy("alias").agg(F.min(F.struct("category", "term")).alias("x"))
    return best.select("alias", "x.term", "x.category", F.length("alias").alias("length"))


# Tune bodies in letter notation

#: Semitones of the letters of letter notation above C.
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
ACCIDENTALS = {"^^": 2, "^": 1, "_": -1, "__": -2, "=": 0}
TOKEN = r"(?:\^\^|\^|__|_|=)?[A-Ga-gzx][,']*(?:\d+)?(?:/\d*)?|\[[^\]]*\](?:\d+)?(?:/\d*)?|\|"
TICKS = 960


def _of(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def letter_midi(token: Column) -> Column:
    """The pitch of a note in letter notation: capitals from middle C, small letters an octave above, commas and quotes by octaves."""
    letter = F.regexp_extract(token, "([A-Ga-g])", 1)
    marks = F.regexp_extract(token, "^(\\^\\^|\\^|__|_|=)", 1)
    octave = F.when(letter == F.lower(letter), 12).otherwise(0) + 12 * (F.length(token) - F.length(F.replace(token, F.lit("'"), F.lit(""))))
    octave = octave - 12 * (F.length(token) - F.length(F.replace(token, F.lit(","), F.lit(""))))
    return F.when(letter != "", 60 + _of(LETTERS)[F.upper(letter)] + octave + F.coalesce(_of(ACCIDENTALS)[marks], F.lit(0)))


def letter_ticks(token: Column, unit: int) -> Column:
    """The duration of a token in ticks, unit being that of a bare note: digits multiply, a slash halves or divides."""
    tail = F.regexp_extract(token, r"(\d+)?(/\d*)?$", 0)
    times = F.coalesce(F.regexp_extract(tail, r"^(\d+)", 1).try_cast("int"), F.lit(1))
    by = F.when(tail.contains("/"), F.coalesce(F.regexp_extract(tail, r"/(\d+)", 1).try_cast("int"), F.lit(2))).otherwise(F.lit(1))
    return F.floor(times * unit / by).cast("int")


def tune_events(tunes: DataFrame, key: str, body: str, unit: int = TICKS // 2) -> DataFrame:
    """Events of tune bodies: key, idx, token, kind (note, chord, rest or bar), bar from 0, onset and duration in ticks, and midis. All
    by splitting and windows: a tune is one key's rows."""
    from pyspark.sql import Window

    tokens = tunes.select(key, F.posexplode(F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col(body), F.lit("")), '"[^"]*"|![^!]*!', ""), F.lit(f"({TOKEN})"), F.lit(1))).alias("idx", "token"))
    t = F.col("token")
    kind = F.when(t == "|", "bar").when(t.startswith("["), "chord").when(t.rlike("^[zx]"), "rest").otherwise("note")
    inner = F.regexp_extract_all(t, F.lit(r"((?:\^\^|\^|__|_|=)?[A-Ga-g][,']*)"), F.lit(1))
    w = Window.partitionBy(key).orderBy("idx")
    rows = tokens.withColumn("kind", kind).withColumn("duration", F.when(F.col("kind") == "bar", 0).otherwise(letter_ticks(t, unit)))
    return rows.select(
        key, "idx", "token", "kind", F.sum((F.col("kind") == "bar").cast("int")).over(w).alias("bar"),
        (F.sum("duration").over(w) - F.col("duration")).alias("onset"), "duration", F.when(F.col("kind").isin("note", "chord"), F.transform(inner, lambda x: letter_midi(x))).alias("midis"),
    )


# Growing windows of captured events


def event_hash(event: Column) -> Column:
    return F.sha2(F.to_json(event), 256)


def growth_joins(windows: DataFrame, key: str, order: str, hashes: str) -> DataFrame:
    """Each window (an array of event hashes) beside the one before it: extends where it is that window and one more event, slides where
    its beginning is that window's end, else restart; new holds the hashes that it adds."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    both = windows.withColumn("before", F.lag(hashes).over(w))
    h, b = F.col(hashes), F.col("before")
    extends = (F.size(h) == F.size(b) + 1) & (F.slice(h, F.lit(1), F.size(b)) == b)
    slides = (F.size(h) == F.size(b)) & (F.size(b) > 0) & (F.slice(h, F.lit(1), F.greatest(F.size(b) - 1, F.lit(0))) == F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))))
    step = F.when(b.isNull(), "start").when(extends, "extends").when(slides, "slides").otherwise("restart")
    new = F.when(step.isin("extends", "slides"), F.slice(h, -1, 1)).otherwise(h)
    return both.select(key, order, step.alias("step"), new.alias("new"))


def merged_calls(calls: DataFrame, windows: DataFrame, keys: list[str], note: str, order: list[str], window_order: list[str]) -> DataFrame:
    """Note calls beside the events of captured windows with equal notes, by hash: within each key the k-th call of a note with its k-th event."""
    from pyspark.sql import Window

    def numbered(df: DataFrame, by: list[str]) -> DataFrame:
        hashed = df.withColumn("__h", event_hash(F.col(note)))
        return hashed.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__h").orderBy(*by)))

    found = numbered(windows, window_order).select(*keys, "__h", "__k", *[c for c in windows.columns if c not in (*keys, *calls.columns)])
    return numbered(calls, order).join(found, [*keys, "__h", "__k"], "left").drop("__h", "__k")


# Sinks


def write_report(events: DataFrame, per_piece: DataFrame, violations: DataFrame, path: str) -> None:
    """Scoring results under a folder, each by Spark's own commit: events as Parquet, pieces as CSV, violations as JSON lines."""
    events.write.mode("overwrite").parquet(f"{path}/per_event")
    per_piece.write.mode("overwrite").option("header", True).csv(f"{path}/per_piece")
    violations.write.mode("overwrite").json(f"{path}/violations")
