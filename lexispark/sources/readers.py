"""Readers of corpora and lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound

GENRES = ("genre", "subgenre", "subsubgenre", "subsubsubgenre")
SOURCES_SCHEMA = "title string, author string, year string, basename string, " + ", ".join(f"{g} string" for g in GENRES) + ", permission string"


def genre_levels(*levels: Column) -> Column:
    """Levels without those that repeat the one before."""
    return F.filter(F.array(*levels), lambda x, i: (i == 0) | ~F.get(F.array(*levels), i - 1).eqNullSafe(x))


def permission_flag(text: Column) -> Column:
    return F.when(text.rlike("(?i)true|false"), F.lower(text) == "true").otherwise(F.coalesce(text == "1", F.lit(False)))


def sources_of(rows: DataFrame) -> DataFrame:
    """The nine string columns of SOURCES_SCHEMA as typed source metadata."""
    path = genre_levels(*[F.col(g) for g in GENRES])
    return rows.select("title", "author", F.col("year").cast("int").alias("year"), "basename", path.alias("genre"), permission_flag(F.col("permission")).alias("permission"))


def read_sources_tsv(spark: SparkSession, folder: str) -> DataFrame:
    return sources_of(spark.read.schema(SOURCES_SCHEMA).option("sep", "\t").option("quote", "").csv(f"{folder}/sources.tsv"))


def read_text_docs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, folder, basename, text) of all .txt files below a folder."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    parts = F.split(path, "/")
    return raw.select(path.alias("path"), F.element_at(parts, -2).alias("folder"), F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("basename"), F.col("value").alias("text"))


# Site folders and their topics.
SITE_TOPICS = {
    "dokujo-tsushin": "独女向け", "it-life-hack": "IT", "kaden-channel": "家電", "livedoor-homme": "男性向け", "movie-enter": "映画",
    "peachy": "女性向け", "smax": "スマートフォン", "sports-watch": "スポーツ", "topic-news": "総合",
}


def parse_header_docs(docs: DataFrame) -> DataFrame:
    """Files (folder, basename, text) that begin with the lines url, date, title: metadata and the array of body lines."""
    lines = F.split(F.regexp_replace("text", r"\n\z", ""), "\n")
    topic = F.try_element_at(F.create_map(*[F.lit(x) for kv in SITE_TOPICS.items() for x in kv]), F.col("folder"))
    return docs.where(~F.col("basename").isin("LICENSE", "README", "CHANGES")).select(
        "basename", F.get(lines, F.lit(2)).alias("title"),
        F.regexp_extract(F.element_at(lines, -1), "（([^）]+)）$", 1).alias("author"),
        F.substring(F.get(lines, F.lit(1)), 1, 4).try_cast("int").alias("year"),
        F.array(F.lit("livedoor"), F.lit("ニュース"), topic).alias("genre"), F.lit(True).alias("permission"),
        F.slice(lines, F.lit(4), F.greatest(F.size(lines) - 3, F.lit(0))).alias("body"),
    )


# Tags of both generations of records, the notice that ends one, and section codes of the two newspapers.
TAGS = {"genre": ("ＡＤ", "ＭＥ", "Ｙ６"), "id": ("Ｃ０", "ＡＦ"), "title": ("Ｔ１", "ＴＩＮ"), "paragraph": ("Ｔ２", "ＨＯＮ")}
NOTICE = "【現在著作権交渉中の為、本文は表示できません】"
DAILY = {
    "０１": "1面", "０２": "2面", "０３": "3面", "０４": "解説", "０５": "社説", "０７": "国際", "０８": "経済", "１０": "特集", "１２": "総合", "１３": "家庭",
    "１４": "文化", "１５": "読書", "１６": "科学", "１７": "生活", "１８": "芸能", "３５": "スポーツ", "４１": "社会",
}
EVENING = {
    "Ｑ０１": "皇室",
    "Ｒ０１": "国際", "Ｒ０２": "アジア 太平洋", "Ｒ０３": "南北アメリカ", "Ｒ０４": "西欧", "Ｒ０５": "旧ソ連・東欧", "Ｒ０６": "中東", "Ｒ０７": "アフリカ",
    "Ｓ０１": "科学", "Ｓ０２": "宇宙", "Ｓ０３": "地球", "Ｓ０４": "理工学", "Ｓ０５": "生命工学", "Ｓ０６": "動植物",
    "Ｔ０１": "犯罪・事件", "Ｔ０２": "事故", "Ｔ０３": "災害",
    "Ｕ０１": "生活", "Ｕ０２": "健康", "Ｕ０３": "衣", "Ｕ０４": "食", "Ｕ０５": "住", "Ｕ０６": "余暇", "Ｕ０７": "行事",
    "Ｖ０１": "文化", "Ｖ０２": "学術", "Ｖ０３": "美術", "Ｖ０４": "映像", "Ｖ０５": "文学", "Ｖ０６": "音楽", "Ｖ０７": "演劇", "Ｖ０８": "芸能", "Ｖ０９": "舞踊",
    "Ｖ１０": "宗教",
    "Ｗ０１": "スポーツ", "Ｗ０２": "巨人軍",
    "Ｘ０１": "社会", "Ｘ０２": "市民運動", "Ｘ０３": "社会保障", "Ｘ０４": "環境", "Ｘ０５": "婦人", "Ｘ０６": "子供", "Ｘ０７": "中高年", "Ｘ０８": "勲章・賞",
    "Ｘ０９": "労働", "Ｘ１０": "教育",
    "Ｙ０１": "経済", "Ｙ０２": "財政", "Ｙ０３": "金融", "Ｙ０４": "企業", "Ｙ０５": "中小企業", "Ｙ０６": "技術", "Ｙ０７": "情報", "Ｙ０８": "サービス", "Ｙ０９": "貿易",
    "Ｙ１０": "国土・都市計画", "Ｙ１１": "鉱工業", "Ｙ１２": "資源・エネルギー", "Ｙ１３": "農林水産",
    "Ｚ０１": "政治", "Ｚ０２": "右翼・左翼", "Ｚ０３": "選挙", "Ｚ０４": "行政", "Ｚ０５": "地方自治", "Ｚ０６": "司法", "Ｚ０７": "警察", "Ｚ０８": "日本外交",
    "Ｚ０９": "軍事", "Ｚ１０": "戦争",
    "": "不明",
}


def section_names() -> dict[str, list[str]]:
    """Section code -> genre path."""
    return {k: ["新聞", paper, v] for paper, names in (("毎日新聞", DAILY), ("読売新聞", EVENING)) for k, v in names.items()}


def parse_tagged_docs(lines: DataFrame) -> DataFrame:
    """(path, line_no, line) of tagged newspaper lines -> records (path, record, basename, year, title, genre, paragraphs). A record starts at an ＩＤ tag; what
    follows the copyright notice in it is left out, and so are records without paragraphs."""
    split = lines.select("path", "line_no", F.regexp_extract("line", "^＼([^＼]+)＼(.+)$", 1).alias("tag"), F.regexp_extract("line", "^＼([^＼]+)＼(.+)$", 2).alias("value"), F.col("line").startswith("＼ＩＤ＼").alias("start"))
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = split.withColumn("record", F.sum(F.col("start").cast("int")).over(order)).where((F.col("record") > 0) & (F.col("tag") != ""))
    inside = Window.partitionBy("path", "record").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    live = numbered.withColumn("stopped", F.max((F.col("value") == NOTICE).cast("int")).over(inside)).where("stopped = 0")
    last = lambda kind: F.max_by(F.when(F.col("tag").isin(*TAGS[kind]), F.col("value")), F.when(F.col("tag").isin(*TAGS[kind]), F.col("line_no")))
    paragraph = F.when(F.col("tag").isin(*TAGS["paragraph"]), F.struct("line_no", "value"))
    r = live.groupBy("path", "record").agg(last("genre").alias("code"), last("id").alias("basename"), F.coalesce(last("title"), F.lit("")).alias("title"), F.sort_array(F.collect_list(paragraph)).alias("p"))
    return _with_year_and_genre(r.where(F.size("p") > 0)).select("path", "record", "basename", "year", "title", "genre", F.transform("p", lambda x: x["value"]).alias("paragraphs"))


def _with_year_and_genre(r: DataFrame) -> DataFrame:
    """Adds year, from the basename, and genre, from the section's code."""
    digits = F.translate(F.when(F.length("basename") == 9, F.substring("basename", 1, 2)).otherwise(F.substring("basename", 3, 2)), "０１２３４５６７８９", "0123456789")
    year = F.concat(F.when(digits.startswith("9"), "19").otherwise("20"), digits)
    known = F.create_map(*[x for k, v in section_names().items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    genre = F.coalesce(F.try_element_at(known, F.col("code")), F.array(F.lit("新聞")))
    return r.withColumn("year", year).withColumns({"year": F.expr("try_cast(year AS int)"), "genre": genre})


RECORD = "＼ＩＤ＼"


def read_tagged_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row for each record of tagged newspaper files. The source itself cuts at the ＩＤ tags, so a file of any size is read in many splits,
    each of which ends at a record; a folder's partition column `path`, or else the file's name, tells records of different files apart."""
    rows = spark.read.option("lineSep", f"\n{RECORD}").text(path)
    name = F.col("path") if "path" in rows.columns else F.col("_metadata.file_path")
    # the first record of a file still has its tag
    return rows.select(name.alias("path"), F.when(F.startswith("value", F.lit(RECORD)), F.substring("value", len(RECORD) + 1, 2**31 - 1)).otherwise(F.col("value")).alias("text"))


def parse_tagged_records(records: DataFrame) -> DataFrame:
    """(path, basename, year, title, genre, paragraphs) of records, each inside its row: the rules of parse_tagged_docs without its windows. Lines before the first
    tag of a file count as a record."""
    line = "^＼([^＼]+)＼(.+)$"

    def tagged(text: Column) -> Column:
        found = F.transform(F.split(text, "\r?\n"), lambda x: F.struct(F.regexp_extract(x, line, 1).alias("tag"), F.regexp_extract(x, line, 2).alias("value")))
        return F.filter(found, lambda x: x["tag"] != "")

    def live(lines: Column) -> Column:
        stop = F.array_position(F.transform(lines, lambda x: x["value"]), NOTICE).cast("int")
        return F.when(stop > 0, F.slice(lines, F.lit(1), stop - 1)).otherwise(lines)

    def values(lines: Column, kind: str) -> Column:
        return F.transform(F.filter(lines, lambda x: x["tag"].isin(*TAGS[kind])), lambda x: x["value"])

    def fields(x: Column) -> Column:
        last = lambda kind: F.try_element_at(values(x, kind), F.lit(-1))
        return F.struct(last("genre").alias("code"), last("id").alias("basename"), F.coalesce(last("title"), F.lit("")).alias("title"), values(x, "paragraph").alias("paragraphs"))

    r = records.select("path", bound(bound(tagged(F.col("text")), live), fields).alias("r")).where(F.size("r.paragraphs") > 0).select("path", "r.*")
    return _with_year_and_genre(r).select("path", "basename", "year", "title", "genre", "paragraphs")


def read_frequency_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pos_1 string, lemma string, freq long").option("sep", "\t").option("quote", "").csv(path)


def level_list(rows: DataFrame) -> DataFrame:
    """(orth, pron, level) -> (word, level): both spellings, trimmed and without ～; of several levels the highest."""
    clean = lambda c: F.trim(F.replace(F.col(c), F.lit("～"), F.lit("")))
    return rows.select(F.explode(F.array(clean("orth"), clean("pron"))).alias("word"), "level").where(F.coalesce(F.col("word") != "", F.lit(False))).groupBy("word").agg(F.max("level").alias("level"))


def read_level_list(spark: SparkSession, path: str) -> DataFrame:
    return level_list(spark.read.schema("orth string, pron string, level int").option("sep", "\t").option("quote", "").csv(path))
