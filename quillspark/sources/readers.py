"""Readers and writers of the corpus' file formats.

Every reader has a fixed schema; nothing is inferred.  Text states that run over
lines (a header that holds for what follows) are carried by window functions with a
file as partition, HTML tables by a table function over one page at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSES = "id bigint, book string, book_slug string, chapter int, verse int, testament string, new string, old string, grc string"
RAW_TOPICS = "id string, sourceTopic string, sourceTopicSlug string, seeAlso array<string>"
RAW_ENTRIES = "id string, topicId string, rawText string"
RAW_ASSERTIONS = "entryId string, book string, chapterStart int, verseStart int, verseEnd int"
ANOMALIES = "id string, source string, kind string, errataId string, reason string, sourceTopicSlug string, entryId string, rawRefGroup string, replaceWith array<string>"
BACKUP_VERSION, BACKUP_CHARS = 3, 1 << 20


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of objects; missing texts become empty."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.fillna("", [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A file that holds one object: rows (key, value)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines do not count."""
    return spark.read.schema(schema).json(path, mode="PERMISSIVE").dropna("all")


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists, in whatever file system it is."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileNotFoundError(", ".join(paths))


def votes_tsv(lines: DataFrame, least_votes: int = 1) -> DataFrame:
    """(source, target, votes) from rows (line); lines with too few fields or votes that are no number go."""
    parts = F.split("line", "\t")
    rows = lines.where(F.size(parts) >= 3).select(parts[0].alias("source"), parts[1].alias("target"), F.expr("try_cast(split(line, '\t')[2] as int)").alias("votes"))
    return rows.where(F.col("votes") >= least_votes)


def path_parts(path: Column) -> list[Column]:
    """(book, chapter): the folder, and the file's number, 1 if it has none."""
    number = F.regexp_extract(path, r"(\d+)[^/]*$", 1)
    return [F.regexp_extract(path, r"([^/]+)/[^/]*$", 1).alias("book"), F.when(number == "", 1).otherwise(number.cast("int")).alias("chapter")]


def forward_fill(lines: DataFrame, group: str, order: str, header: Column, name: str) -> DataFrame:
    """Add ``name``: the last header at or before each line of its group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(header, ignorenulls=True).over(w))


# -- cross-reference text ---------------------------------------------------------------

UNKNOWN = "?"


def reference_text(lines: DataFrame, books: dict[str, str]) -> DataFrame:
    """Edges from rows (file, n, line) of the cross-reference text format.

    ``{Bk 1:1}`` sets the source, ``"topic"`` the topic (outside the reciprocal
    section), ``Reciprocal:`` opens that section, other lines hold references.  A
    header of an unknown book swallows all lines up to the next header.  Of edges
    that agree in source, target and topic the first stays.
    """
    header = F.regexp_extract("line", r"^\{(\w+) (\d+):(\d+)\}$", 0)
    is_header = header != ""
    table = F.create_map(*(F.lit(x) for kv in books.items() for x in kv))
    book = F.coalesce(table[F.regexp_extract("line", r"^\{(\w+) ", 1)], F.lit(UNKNOWN))
    place = F.concat_ws(":", book, F.regexp_extract("line", r" (\d+):", 1), F.regexp_extract("line", r":(\d+)\}", 1))
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("line", F.trim("line")).where("line <> ''")
    rows = rows.withColumn("source", F.last(F.when(is_header, place), ignorenulls=True).over(w)).withColumn("block", F.sum(is_header.cast("int")).over(w))
    inner = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where(~is_header & F.col("source").isNotNull() & ~F.startswith("source", F.lit(UNKNOWN)))
    rows = rows.withColumn("reciprocal", F.max(F.col("line") == "Reciprocal:").over(inner))
    quoted = F.regexp_extract("line", '^"(.*)"$', 1)
    rows = rows.withColumn("topic", F.coalesce(F.last(F.when((quoted != "") & ~F.col("reciprocal"), quoted), ignorenulls=True).over(inner), F.lit("general")))
    rows = rows.where((quoted == "") & (F.col("line") != "Reciprocal:"))
    refs = rows.withColumn("ref", F.explode(F.when(F.col("reciprocal"), F.array("line")).otherwise(F.split("line", r"\s*,\s*"))))
    pattern = r"^(\w+?)_(\d+):(\d+)(?:-(\d+))?(?:\s*-\s*(.*))?$"
    part = lambda i: F.regexp_extract("ref", pattern, i)
    first = F.expr("try_cast(nullif(regexp_extract(ref, r'" + pattern + "', 3), '') as int)")
    edges = refs.select(
        "file", "n", "source", table[part(1)].alias("book"), F.expr("try_cast(regexp_extract(ref, r'" + pattern + "', 2) as int)").alias("chapter"), first.alias("vs"),
        F.coalesce(F.expr("try_cast(nullif(regexp_extract(ref, r'" + pattern + "', 4), '') as int)"), first).alias("ve"),
        F.when(F.col("reciprocal"), "reciprocal").otherwise("thematic").alias("type"), F.when(~F.col("reciprocal"), F.col("topic")).otherwise("reciprocal").alias("topic"), F.when(F.col("reciprocal"), part(5)).otherwise("").alias("note"),
    ).where("book is not null and vs is not null")
    keep = Window.partitionBy("source", "book", "chapter", "vs", "ve", "topic").orderBy("file", "n")
    return edges.withColumn("_r", F.row_number().over(keep)).where("_r = 1").drop("_r")


# -- HTML tables ------------------------------------------------------------------------


class _Page(HTMLParser):
    """The rows of ``td`` cells and the headings of a page; a row counts when its ``tr`` is closed."""

    HEADINGS = ("h1", "h2")

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.headings = dict.fromkeys(self.HEADINGS, "")
        self._row: list[str] = []
        self._into: str | None = None
        self._text = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "td" or tag in self.HEADINGS:
            self._into, self._text = tag, ""

    def handle_endtag(self, tag: str) -> None:
        if tag == "td" and self._into == "td":
            self._row.append(self._text)
        elif tag == "tr":
            self.rows.append(self._row)
            self._row = []
        elif tag in self.HEADINGS and self._into == tag:
            self.headings[tag] = " ".join(self._text.split())
        if tag == self._into:
            self._into = None

    def handle_data(self, data: str) -> None:
        if self._into:
            self._text += data


def _number(text: str) -> int | None:
    try:
        return int(text)
    except ValueError:
        return None


def merge_rows(rows: list[list[str]]) -> list[tuple[int, str, str]]:
    """Verses (number, new, old) from table rows.

    Four cells are the number and the text of the new and of the old translation.  A new
    number leads: both texts join the latest verse of that number, else they make one.  With an old
    number only the old text does so; without numbers it joins the last verse.  Three cells are a number and both texts,
    and always a verse of their own.  Rows whose number is none go, and verses without text.
    """
    verses: list[list] = []
    latest: dict[int, int] = {}

    def join(verse: list, side: int, text: str) -> None:
        verse[side] = f"{verse[side]} {text}" if verse[side] and text else verse[side] or text

    def open_verse(number: int) -> list:
        if number not in latest:
            latest[number] = len(verses)
            verses.append([number, "", ""])
        return verses[latest[number]]

    for cells in rows:
        cells = [" ".join(c.split()) for c in cells]
        if len(cells) >= 4:
            lead = cells[0] or cells[2]
            number = _number(lead) if lead else None
            if number is not None:
                verse = open_verse(number)
                if cells[0]:
                    join(verse, 1, cells[1])
                join(verse, 2, cells[3])
            elif not lead and verses:
                join(verses[-1], 2, cells[3])
        elif len(cells) == 3 and (number := _number(cells[0])) is not None:
            latest[number] = len(verses)
            verses.append([number, *cells[1:]])
    return [(n, new, old) for n, new, old in verses if new or old]


def html_verses(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rows (key, book, chapter, pos, verse, new, old) of the tables in each page; its headings name book and chapter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch["key"], batch["html"], strict=True):
                page = _Page()
                page.feed(text or "")
                out += [(k, *page.headings.values(), pos, *row) for pos, row in enumerate(merge_rows(page.rows))]
            yield pd.DataFrame(out, columns=["key", "book", "chapter", "pos", "verse", "new", "old"])

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {pages.schema[key].dataType.simpleString()}, book string, chapter string, pos int, verse int, new string, old string")


# -- backups and sinks ------------------------------------------------------------------

BACKUP = "version int, exported timestamp, data map<string,string>"


def valid_backups(texts: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Parsed backups that may be imported: known version, allowed keys only, no value too long."""
    parsed = texts.withColumn("backup", F.from_json(column, BACKUP))
    fits = F.col("backup").isNotNull() & (F.col("backup.version") <= BACKUP_VERSION) & F.col("backup.data").isNotNull()
    data = F.map_filter("backup.data", lambda k, x: k.isin(*allowed) & (F.length(x) <= BACKUP_CHARS))
    return parsed.where(fits).withColumn("data", data)


def backup(state: DataFrame, user: str) -> DataFrame:
    """One backup text per user from rows (user, key, value)."""
    data = F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value"))))
    return state.groupBy(user).agg(F.to_json(F.struct(F.lit(BACKUP_VERSION).alias("version"), data.alias("data"))).alias("backup"))


def write_version(df: DataFrame, path: str, version: str, dry_run: bool = True, kind: str = "parquet") -> str:
    """Write next to what is there instead of over it, as Parquet or as JSON lines; a dry run only names the place."""
    target = f"{path.rstrip('/')}/version={version}"
    if not dry_run:
        df.write.mode("errorifexists").format(kind).save(target)
    return target


def changes(df: DataFrame, target: str, key: str, columns: list[str], kind: str = "parquet") -> DataFrame:
    """What a version of ``df`` would change against the one at ``target``: (key, kind, changed) of ``table_diff``."""
    from ..operators.quality import table_diff

    old = df.sparkSession.read.schema(df.schema).format(kind).load(target)
    return table_diff(old, df, key, columns)
