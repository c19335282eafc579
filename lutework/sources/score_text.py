"""Scores as text: a line for each row, section marks and bars between, and an index map with run-length coded sections, so that nothing is lost.

A score's text is made of its rows by column expressions and windows over its order, and is one row of a DataFrame; files are written and read by Spark's text source, a folder for each score, so that
they may lie wherever Spark reads. `rows_of` reads version 1.2 and the older 1.1, which has a line of column names and states each row's section in full.

Defined results: null and empty fields stay what they are; rows without index read back with the index that the map gives them only where it says one, else null; line breaks in a title or a mark, which are shown
only, become blanks, and stay in the metadata and the section; a score without rows is its head alone, and no rows; texts of other schemes have no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as cells

# Names of the format's lines and of its columns.
SCHEME, OLDER = "GQS｜teacher-gqs-1.2", "GQS｜teacher-gqs-1.1"
COLUMNS = "序号｜简谱｜ABC｜时值｜减字"
FIELDS = ["jianpu", "jianpu_alt", "abc", "duration", "lyric", "jianzi", "jianzi_text"]
BAR = {"jianpu": "|", "jianpu_alt": None, "abc": "|", "duration": "小节线", "lyric": "", "jianzi": "", "jianzi_text": None}
SECTION = "struct<number:int,label:string,title:string,marker:string,start:boolean>"
MAP = f"struct<`线`:array<int>,`音起点`:int,`音`:array<int>,`节定义`:array<{SECTION}>,`节段`:array<array<int>>,`线字段`:array<struct<index:int,jianpu:string,jianpu_alt:string,abc:string,duration:string,lyric:string,jianzi:string,jianzi_text:string,structure_token:string>>>"
KEEP = {"ignoreNullFields": "false"}


def _shown(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "))


def _mark(section: Column) -> Column:
    """What a section is announced by: its mark, or its label and title in brackets; empty if it has neither."""
    label, title = _shown(section["label"]), _shown(section["title"])
    named = F.concat(F.lit("<"), label, F.when(title != "", F.concat(F.lit(" "), title)).otherwise(""), F.lit(">"))
    return F.coalesce(F.nullif(_shown(section["marker"]), F.lit("")), F.when(label != "", named), F.lit(""))


def texts(notes: DataFrame, metadata: DataFrame) -> DataFrame:
    """score and text of each score. notes: score, pos (its order), index, structural, structure_token, section and FIELDS; metadata: score, title and metadata, a JSON object as text."""
    w = Window.partitionBy("score").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    mark = _mark(F.col("section"))
    rows = notes.select("score", "pos", "index", "structural", "structure_token", "section", *FIELDS, mark.alias("mark"), (F.row_number().over(w) - 1).alias("n"))
    rows = rows.withColumn("ordinal", F.count_if(~F.col("structural")).over(w) - 1)
    new = (F.col("mark") != "") & ~F.col("mark").eqNullSafe(F.last(F.nullif(F.col("mark"), F.lit("")), ignorenulls=True).over(before))
    head = F.when(new, F.concat(F.lit("\n"), F.col("mark"), F.lit("\n" + COLUMNS + "\n"))).when(F.col("n") == 0, "\n" + COLUMNS + "\n").otherwise("")
    kind = cells.structure(F.coalesce("structure_token", "abc"))["label"]
    bar = F.when(F.coalesce(kind, F.lit("小节线")) == "小节线", "小节线").otherwise(F.concat(F.lit("结构｜"), kind))
    sound = F.concat(F.lit("音｜["), F.col("ordinal").cast("string"), F.lit(","), F.substring(F.to_json(F.array(*FIELDS), KEEP), 2, 1 << 30))
    line = F.concat(head, F.when(F.col("structural"), bar).otherwise(sound))
    given = F.struct("index", *FIELDS, "structure_token")
    odd = F.col("structural") & (F.col("structure_token").isNotNull() | ~F.forall(F.array(*[F.col(k).eqNullSafe(F.lit(v)) for k, v in BAR.items()]), lambda x: x))
    kept = F.struct("n", "index", "structural", line.alias("line"), F.coalesce(F.to_json("section", KEEP), F.lit("null")).alias("section"), F.when(F.col("structural"), given).alias("bar"), odd.alias("odd"))
    per = rows.select("score", kept.alias("r")).groupBy("score").agg(F.array_sort(F.collect_list("r")).alias("r"))  # one score's rows, which make one text
    part = lambda name: F.transform("r", lambda x: x[name])
    bars, sounds = F.filter("r", lambda x: x["structural"]), F.filter("r", lambda x: ~x["structural"])
    defined = F.array_distinct(part("section"))
    per = per.withColumn("defined", defined)  # once a score, not once a row
    per = per.withColumn("ids", F.transform("r", lambda x: (F.array_position("defined", x["section"]) - 1).cast("int")))
    starts = F.filter(F.transform("ids", lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get("ids", i - 1)), i)), lambda i: i.isNotNull())
    per = per.withColumn("starts", starts)
    runs = F.transform("starts", lambda s, k: F.array(s, F.coalesce(F.get("starts", k + 1), F.size("r")), F.get("ids", s)))
    whole = F.forall("r", lambda x: x["index"].isNotNull() & (x["index"] - x["n"] == F.get("r", 0)["index"]))
    indexes = lambda some: F.to_json(F.transform(some, lambda x: x["index"]), KEEP)
    placed = F.when(whole, F.concat(F.lit('"音起点":'), F.get("r", 0)["index"].cast("string"))).otherwise(F.concat(F.lit('"音":'), indexes(sounds)))
    fields = F.when(F.exists("r", lambda x: F.coalesce(x["odd"], F.lit(False))), F.concat(F.lit(',"线字段":'), F.to_json(F.transform(bars, lambda x: x["bar"]), KEEP))).otherwise("")
    mapped = F.concat(F.lit('{"线":'), indexes(bars), F.lit(","), placed, F.lit(',"节定义":['), F.array_join("defined", ","), F.lit('],"节段":'), F.to_json(runs), fields, F.lit("}"))
    out = metadata.select("score", "title", "metadata").join(per.select("score", mapped.alias("map"), F.array_join(part("line"), "\n").alias("lines")), "score", "left")
    top = F.concat(F.lit(SCHEME + "\n谱名｜"), _shown(F.coalesce("title", F.lit("未命名"))), F.lit("\n元数据｜"), F.regexp_replace(F.coalesce("metadata", F.lit("{}")), r"[\r\n]+", " "), F.lit("\n索引映射｜"), F.coalesce("map", F.lit('{"线":[],"音":[]}')), F.lit("\n"))
    return out.select("score", F.concat(top, F.coalesce(F.concat("lines", F.lit("\n")), F.lit(""))).alias("text"))


def _after(lines: Column, name: str) -> Column:
    return F.substring(F.get(F.filter(lines, lambda x: x.startswith(f"{name}｜")), 0), len(name) + 2, 1 << 30)


def metadata_of(read: DataFrame) -> DataFrame:
    """score and metadata (a JSON object as text) of texts (score, text)."""
    return read.select("score", _after(F.split("text", "\n"), "元数据").alias("metadata"))


def rows_of(read: DataFrame) -> DataFrame:
    """The rows of texts (score, text): score, pos, index, structural, structure_token, section and FIELDS."""
    lines = F.split("text", "\n")
    is_bar, is_sound = lambda x: (x == "小节线") | x.startswith("结构｜"), lambda x: x.startswith("音｜")
    one = read.select("score", F.get(lines, 0).alias("scheme"), lines.alias("lines"), F.from_json(_after(lines, "索引映射"), MAP).alias("map"))
    # what the map says of a line is put beside it within the text's row, so that no line carries the map along
    own = one.where(F.col("scheme") == SCHEME).withColumn("lines", F.transform(F.filter("lines", lambda x: is_bar(x) | is_sound(x)), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))))
    own = own.withColumns({"bars": F.filter("lines", lambda x: is_bar(x["line"])), "sounds": F.filter("lines", lambda x: ~is_bar(x["line"]))})
    said = F.col("map")
    section = lambda pos: F.get(said["节定义"], F.get(F.filter(said["节段"], lambda r: (F.get(r, 0) <= pos) & (pos < F.get(r, 1))), 0)[2])
    at = lambda pos: F.when(said["音起点"].isNotNull(), said["音起点"] + pos)
    given = lambda k: F.get(said["线字段"], k)

    def placed(x: Column, bar: bool, index: Column, fields: Column) -> Column:
        return F.struct(x["pos"].alias("pos"), x["line"].alias("line"), F.lit(bar).alias("bar"), index.alias("index"), fields.alias("given"), section(x["pos"]).alias("section"))

    bars = F.transform("bars", lambda x, k: placed(x, True, F.coalesce(given(k)["index"], F.get(said["线"], k)), given(k)))
    sounds = F.transform("sounds", lambda x, k: placed(x, False, F.coalesce(F.get(said["音"], k), at(x["pos"])), F.when(F.lit(False), given(k))))
    own = own.select("score", F.explode(F.concat(bars, sounds)).alias("x")).select("score", "x.*").withColumn("values", F.from_json(F.substring("line", 3, 1 << 30), "array<string>"))
    given, section, index = F.col("given"), F.col("section"), F.col("index")
    stated = lambda i, name: F.when(F.col("bar"), F.when(given.isNotNull(), given[name]).otherwise(F.lit(BAR[name]).cast("string"))).otherwise(F.get("values", F.lit(i + 1)))
    fields = [stated(i, name).alias(name) for i, name in enumerate(FIELDS)]
    new = own.select("score", "pos", index.cast("int").alias("index"), F.col("bar").alias("structural"), F.when(F.col("bar"), given["structure_token"]).alias("structure_token"), section.alias("section"), *fields)
    old = one.where(F.col("scheme") == OLDER).select("score", F.posexplode(F.filter("lines", is_sound)).alias("pos", "line"))
    old = old.withColumn("values", F.from_json(F.substring("line", 3, 1 << 30), "array<string>"))
    cell = lambda i: F.get("values", F.lit(i))
    bar = cells.structure(cell(3)).isNotNull()
    older = old.select("score", "pos", cell(0).cast("int").alias("index"), bar.alias("structural"), F.lit(None).cast("string").alias("structure_token"), F.from_json(cell(8), SECTION).alias("section"), *[cell(i + 1).alias(name) for i, name in enumerate(FIELDS)])
    return new.unionByName(older)


def write(scores: DataFrame, path: str) -> None:
    """Texts (score, text) as files, one in a folder for each score."""
    scores.select("score", "text").write.partitionBy("score").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """score (as text) and text of the files below a path. Each file is read whole, as one text."""
    found = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(path, wholetext=True)
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    name = plain(plain(F.regexp_extract(F.col("_metadata.file_path"), "score=([^/]*)/", 1)))  # the folder's name is escaped, and so is the path that has it
    return found.select(name.alias("score"), F.regexp_replace("value", "\n\n?$", "\n").alias("text"))
