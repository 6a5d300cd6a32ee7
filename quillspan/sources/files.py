"""Readers and writers of files: JSONL, CSV, lines, archives, policy files; missing inputs give empty tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines under a declared schema; blank lines are skipped, unknown fields ignored."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line with all keys, nulls included."""
    df.write.option("ignoreNullFields", "false").json(path)


def flat_for_csv(df: DataFrame, separator: str = "|") -> DataFrame:
    """Arrays joined, nulls as empty strings: what a CSV file can hold."""
    cols = [(F.concat_ws(separator, F.transform(f.name, lambda x: x.cast("string"))) if isinstance(f.dataType, T.ArrayType) else F.coalesce(F.col(f.name).cast("string"), F.lit(""))).alias(f.name) for f in df.schema.fields]
    return df.select(*cols)


def write_csv(df: DataFrame, path: str) -> None:
    flat_for_csv(df).write.option("header", True).option("emptyValue", "").csv(path)


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(id, definition) of a CSV vocabulary; empty if there is no such file."""
    try:
        return spark.read.option("header", True).csv(path).select("id", "definition")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "id string, definition string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of whole text files; lines count from 1 in each file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("_i", "value"))
    return whole.select("path", (F.col("_i") + 1).alias("line"), "value")


def read_policy(path: str) -> dict:
    """A YAML policy. A list item that YAML reads as a truth value (an unquoted yes, no, on, off) is an error."""
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}

    def check(x: object, where: str) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                check(v, f"{where}.{k}")
        elif isinstance(x, list):
            for v in x:
                if isinstance(v, bool):
                    raise ValueError(f"{where}: quote {v!r}")
                check(v, where)

    check(data, Path(path).name)
    return data


_VERSE = re.compile(r"^([A-Z0-9]{3}) (\d+):(\d+) (.*)$")


def read_verse_archive(spark: SparkSession, path: str) -> DataFrame:
    """(book, chapter, verse, text) of verse-per-line text files in zip archives; other lines are ignored."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.endswith(".txt"):
                            rows += [(m[1], int(m[2]), int(m[3]), m[4]) for line in z.read(name).decode("utf-8-sig").splitlines() if (m := _VERSE.match(line))]
                yield pd.DataFrame(rows, columns=["book", "chapter", "verse", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "book string, chapter int, verse int, text string")


def load_each(loaders: dict) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Sources that load, and a status for each; one that fails doesn't stop the others."""
    out, status = {}, {}
    for name, load in loaders.items():
        try:
            df = load()
            df.limit(1).count()
            out[name], status[name] = df, "available"
        except Exception as e:  # any fault of a source concerns only this source
            status[name] = f"unavailable: {type(e).__name__}"
    return out, status


def write_if_clean(tables: dict[str, DataFrame], problems: DataFrame, base: str) -> bool:
    """All tables or, if there is any problem, none."""
    if not problems.isEmpty():
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    return True
