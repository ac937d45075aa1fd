"""Records (rid, id, label, seq) from tables and FASTA files; FASTA and external-cluster input and output."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_table(df: DataFrame, rid: str, seq: Column, label: Column | None = None, id_: Column | None = None) -> DataFrame:
    """Any table as records; the sequence loses white space and is upper-cased."""
    clean = F.upper(F.regexp_replace(F.coalesce(seq.cast("string"), F.lit("")), r"\s+", ""))
    return df.select(F.col(rid).cast("long").alias("rid"), (F.col(rid).cast("string") if id_ is None else id_).alias("id"), (F.lit(None) if label is None else label).cast("int").alias("label"), clean.alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA files as records, rid in order of path and header line.

    Handles a byte-order mark, CRLF, blank and wrapped lines; a header's last field after | is
    the label if it is 0 or 1; records without sequence are dropped.  Raises ValueError with the
    line number for an empty header or id and for sequence before the first header.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    lines = text.select("path", F.posexplode(F.split("value", r"\r\n|\n|\r", -1)).alias("line", "raw")).select("path", "line", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("raw")).where("raw <> ''")
    head = F.col("raw").startswith(">")
    w = Window.partitionBy("path").orderBy("line")
    own = lines.withColumn("head", head).withColumn("rec", F.sum(head.cast("int")).over(w))
    name = F.trim(F.expr("substring(raw, 2)"))
    tail = F.element_at(F.split(name, r"\|"), -1)
    labelled = F.contains(name, F.lit("|")) & tail.isin("0", "1")
    ident = F.when(labelled, F.trim(F.expr("substring(raw, 2)")).substr(F.lit(1), F.length(name) - 2)).otherwise(name)
    own = own.withColumn("name", F.when(head, name)).withColumn("id", F.when(head, F.trim(ident))).withColumn("label", F.when(head & labelled, tail.cast("int")))
    wrong = own.select("line", F.when(F.col("rec") == 0, F.lit("sequence before first header")).when(F.col("head") & (F.col("name") == ""), F.lit("empty header")).when(F.col("head") & (F.col("id") == ""), F.lit("empty identifier")).alias("error")).where("error is not null")
    if (first := wrong.orderBy("line").first()) is not None:
        raise ValueError(f"line {first['line'] + 1}: {first['error']}")
    seqs = own.groupBy("path", "rec").agg(
        F.min("line").alias("line"), F.max("id").alias("id"), F.max("label").alias("label"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line", F.upper(F.regexp_replace("raw", r"\s+", "")).alias("s"))))), lambda x: x["s"]), "").alias("seq"),
    )
    kept = seqs.where("seq <> ''")
    return kept.select((F.row_number().over(Window.orderBy("path", "line")) - 1).cast("long").alias("rid"), "id", "label", "seq")


def fasta_text(wrap: int = 60) -> Column:
    """One record as FASTA text."""
    if isinstance(wrap, bool) or not isinstance(wrap, int) or wrap < 1:
        raise ValueError("wrap must be an integer of 1 or more")
    head = F.concat(F.lit(">"), F.col("id"), F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("|"), F.col("label").cast("string"))))
    return F.concat(head, F.lit("\n"), F.regexp_replace("seq", f"(.{{{wrap}}})(?=.)", "$1\n"))


def write_fasta(records: DataFrame, path: str, wrap: int = 60) -> None:
    """A folder of FASTA part files in the order of rid."""
    records.orderBy("rid").select(fasta_text(wrap).alias("value")).write.mode("overwrite").text(path)


def write_fasta_file(records: DataFrame, path: str, wrap: int = 60) -> None:
    """One local FASTA file, streamed through the driver partition by partition."""
    with open(path, "w", encoding="utf-8", newline="\n") as out:
        for row in records.orderBy("rid").select(fasta_text(wrap).alias("value")).toLocalIterator():
            out.write(row["value"] + "\n")


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """train, val and test FASTA files of a folder as records with a column split."""
    out = None
    for split, names in (("train", ["train"]), ("val", ["val", "valid"]), ("test", ["test"])):
        found = [f"{folder}/{n}.{ext}" for n in names for ext in ("fasta", "fa", "faa") if os.path.exists(f"{folder}/{n}.{ext}")]
        if not found:
            raise FileNotFoundError(f"no FASTA file for {split} in {folder}")
        part = read_fasta(spark, found[0]).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def read_clusters(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(rid, cluster_id) from JSON {index: cluster} or CSV index,cluster; the indices must be exactly 0 to n - 1."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            rows = [(int(k), int(v)) for k, v in json.load(f).items()]
        df = spark.createDataFrame(rows, "rid long, cluster_id long")
    else:
        df = spark.read.csv(path, header=True).select(F.col("index").cast("long").alias("rid"), F.col("cluster").cast("long").alias("cluster_id"))
    got = df.agg(F.count("*"), F.count_distinct("rid"), F.min("rid"), F.max("rid")).first()
    if tuple(got) != (n, n, 0, n - 1):
        raise ValueError("cluster assignments must name every record once")
    return df
