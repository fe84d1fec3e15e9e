"""Reading collections: tab-separated lines, ids, length sidecars, id lists; and writing results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.analysis import SPACE
from quarrylight.operators.prefix import running_total

_ID = r"^[ \t\n\x0B\f\r]*\+?([0-9]+)"


def parsed_line(line: Column) -> tuple[Column, Column]:
    """(external id, text): the first tab parts them; a line without one is all text and has no id."""
    tab = F.instr(line, "\t")
    external = F.when(tab > 0, F.substring_index(line, "\t", 1)).otherwise(F.lit(""))
    return external, F.when(tab > 0, F.substr(line, tab + 1)).otherwise(line)


def resolved_id(external: Column, ordinal: Column) -> Column:
    """The number that the id begins with; without one, or beyond 63 bits, the line's ordinal from 1."""
    return F.coalesce(F.regexp_extract(external, _ID, 1).try_cast("bigint"), (ordinal + 1).cast("bigint"))


def scan_lines(lines: DataFrame, max_docs: int | None = None) -> DataFrame:
    """(doc_id, external_id, text) of (ordinal, line). Empty lines are skipped but use up an ordinal; ``max_docs`` bounds it."""
    kept = lines.where("line is not null and line <> ''")
    if max_docs is not None:
        kept = kept.where(F.col("ordinal") < max_docs)
    external, text = parsed_line(F.col("line"))
    return kept.select(resolved_id(external, F.col("ordinal")).alias("doc_id"), external.alias("external_id"), text.alias("text"))


def read_tsv(spark: SparkSession, path: str, max_docs: int | None = None) -> DataFrame:
    """``scan_lines`` of text files; lines are numbered in the order of the files' names and of their offsets."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return scan_lines(running_total(lines, ["file", "block", "row"], ordinal=F.lit(1)), max_docs)


def docmap(docs: DataFrame) -> DataFrame:
    """(doc_id, external_id)."""
    external = F.col("external_id") if "external_id" in docs.columns else F.col("doc_id").cast("string")
    return docs.select("doc_id", external.alias("external_id"))


def collection_scan(docs: DataFrame, max_docs: int | None = None) -> DataFrame:
    """(doc_id, n_bytes) of texts that are not empty, the first ``max_docs`` in id order if given."""
    rows = docs.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))
    if max_docs is not None:
        rows = running_total(rows, ["doc_id"], ordinal=F.lit(1)).where(F.col("ordinal") < max_docs).drop("ordinal")
    return rows.where("n_bytes > 0")


def sidecar_length(line: Column) -> Column:
    """The last token of a line that is all digits, else 0."""
    numbers = F.filter(F.split(line, SPACE), lambda t: t.rlike("^[0-9]+$"))
    return F.coalesce(F.try_element_at(numbers, F.lit(-1)).try_cast("bigint"), F.lit(0).cast("bigint"))


def sidecar(docs: DataFrame) -> DataFrame:
    """(row_pos, dl): lengths read from lines, by position among those that are not empty."""
    lines = docs.where("text is not null and text <> ''").select("doc_id", sidecar_length(F.col("text")).alias("dl"))
    return running_total(lines, ["doc_id"], row_pos=F.lit(1)).select("row_pos", "dl")


def doc_ids(text: str) -> list[int]:
    """Ids apart by commas, spaces or line ends; other words are passed over."""
    return [int(t) for t in re.split(r"[,\s]+", text) if t.isascii() and t.isdigit()]


def doc_ids_file(path: str) -> list[int]:
    with open(path, encoding="utf-8") as f:
        return doc_ids(f.read())


def lexicon_from_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon file with a header: columns by name, in any order, others left out; short rows are skipped.

    A missing column or an empty file is an error.
    """
    names = ["term", "start_slot", "end_slot", "first_block", "num_blocks", "ft"]
    rows = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    if missing := [n for n in names if n not in rows.columns]:
        raise ValueError(f"lexicon without columns {missing}")
    out = rows.select("term", *[F.col(n).try_cast("bigint").alias(n) for n in names[1:]]).dropna()
    if not out.take(1):
        raise ValueError("lexicon without rows")
    return out


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_json_lines(snippet_json: DataFrame, path: str) -> None:
    """The ``json`` column of ``snippets.snippet_json``, an object {"docID": n, "snippets": [..]} per line."""
    snippet_json.select("json").write.mode("overwrite").text(path)
