"""Transcript exports as turns: text with role headers, one file a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions.text import strip

#: Header lines of the two export formats, fixed by what writes them; the role's name stands in the group.
TEXT_HEADER = r"(?m)^(User|Claude):[ \t\x0b\f\r]*$"
MARKDOWN_HEADER = r"(?m)^\*\*(User|Assistant):\*\*[ \t\x0b\f\r]*$"
EXTENSIONS = (".txt", ".md")


def parsed(text: Column, header: str) -> Column:
    """Array of (role, text) of the turns with a body: what lies between header lines, the text before the first left out."""
    # a header is a line of its own, so it ends with a line break; one at the very end of the text heads nothing
    names = F.regexp_extract_all(text, F.lit(header), F.lit(1))
    bodies = F.split(text, header, -1)
    turns = F.transform(names, lambda n, i: F.struct(F.when(n == "User", "user").otherwise("assistant").alias("role"), strip(F.get(bodies, i + 1)).alias("text")))
    return F.filter(turns, lambda t: t["text"] != "")


def parse_txt(text: Column) -> Column:
    return parsed(text, TEXT_HEADER)


def parse_md(text: Column) -> Column:
    return parsed(text, MARKDOWN_HEADER)


def parse_export(text: Column, name: Column) -> Column:
    """Markdown by the exact suffix .md, anything else as text."""
    return F.when(name.endswith(".md"), parse_md(text)).otherwise(parse_txt(text))


def numbered(files: DataFrame, turns: Column) -> DataFrame:
    """filename, turn (from 0), role, text; files without turns vanish."""
    return files.select("filename", F.posexplode(turns).alias("turn", "t")).select("filename", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """filename and content of the files at a path: bad UTF-8 replaced, line ends made \\n."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return files.select(name.alias("filename"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\r\n?", "\n").alias("content"))


def load_directory(spark: SparkSession, directory: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Turns of the exports directly in a folder, by their exact suffix."""
    files = _files(spark, directory).where(F.regexp_extract("filename", r"(?s)^.+(\.[^.]+)$", 1).isin(*extensions))
    return numbered(files, parse_export(F.col("content"), F.col("filename")))


def load_conversation(spark: SparkSession, path: str) -> DataFrame:
    """Turns of one export, whatever its suffix."""
    return numbered(_files(spark, path), parse_export(F.col("content"), F.col("filename")))


def rendered(turns: DataFrame, markdown: bool) -> DataFrame:
    """conv_id and export text of the user and assistant turns: what the parsers read."""
    names = ("**User:**", "**Assistant:**") if markdown else ("User:", "Claude:")
    block = F.concat(F.when(F.col("role") == "user", names[0]).otherwise(names[1]), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    rows = turns.where(F.col("role").isin("user", "assistant")).select("conv_id", F.struct("turn", block.alias("block")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["block"]), "").alias("content"))
