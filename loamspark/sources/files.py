"""Sources besides parquet tables: JSON lines, transcripts, markdown lines, directory snapshots, source code."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT = "type string, id string, timestamp string, message struct<role: string, content: array<struct<type: string, text: string>>>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines_with_bad(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of a JSON-lines file, where bad ones are set aside as text."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad IS NULL").select("r.*").drop("_bad"), parsed.where("r._bad IS NOT NULL").select("value")


def embedded_json(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Rows of JSON lines inside a text column; a line NONE stands for no row, malformed lines are left out."""
    line = df.select(F.explode(F.split(text, "\n")).alias("line")).where("trim(line) <> '' AND trim(line) <> 'NONE'")
    return line.select(F.from_json("line", schema).alias("r")).where("r IS NOT NULL").select("r.*")


def transcript_texts(events: DataFrame) -> DataFrame:
    """(id, at, role, text) of a transcript's messages: text parts only, without reasoning blocks."""
    part = events.where("type = 'message'").select("id", "timestamp", F.col("message.role").alias("role"), F.explode("message.content").alias("c"))
    text = F.trim(F.regexp_replace("c.text", "(?s)<think>.*?</think>", ""))
    return part.where("c.type = 'text'").select("id", F.try_to_timestamp("timestamp").alias("at"), "role", text.alias("text")).where("text <> ''")


def markdown_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, line) of bullets and headings in markdown files under path."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path)
    return lines.where(F.col("value").rlike("^(- |## |### )")).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("line"))


def directory_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, size, sha1) of every file under path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha1("content").alias("sha1"))


def newest_file(snapshot: DataFrame, group: Column) -> DataFrame:
    """(group, path) of the newest file of each group of a directory_snapshot."""
    return snapshot.groupBy(group.alias("group")).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path, code in zip(b["path"].to_pylist(), b["code"].to_pylist(), strict=True):
            try:
                found = ast.parse(code or "")
            except (SyntaxError, ValueError, RecursionError):
                continue
            todo = [(found, "", None)]
            while todo:
                node, prefix, inside = todo.pop()
                for child in ast.iter_child_nodes(node):
                    if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        name = f"{prefix}{child.name}"
                        kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside else "function"
                        rows.append((path, kind, name, inside, child.lineno, child.end_lineno, ast.get_docstring(child)))
                        todo.append((child, f"{name}.", child.name if kind == "class" else None))
                    else:
                        todo.append((child, prefix, inside))
        names = ["path", "kind", "name", "class_name", "line_start", "line_end", "docstring"]
        kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()]
        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def python_chunks(files: DataFrame) -> DataFrame:
    """Functions, methods and classes of (path, code) rows, nested ones too; code that can't be parsed has none."""
    return files.select("path", "code").mapInArrow(_chunks, "path string, kind string, name string, class_name string, line_start int, line_end int, docstring string")
