"""Binary sources: office documents as paragraphs, and a quantised encoder."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: the namespace of a document's paragraphs and text runs.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def paragraphs_of_docx(data: bytes) -> list[str]:
    """Squashed texts of the paragraphs that have any."""
    with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("word/document.xml") as f:
        out = []
        for _, element in ElementTree.iterparse(f):
            if element.tag == f"{WORD}p":
                runs = [t.text or "" for t in element.iter(f"{WORD}t")]
                out.append(" ".join("".join(runs).split()))
                element.clear()
    return list(filter(None, out))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, paragraphs, link) of every document under path; a file that isn't one gives no paragraph."""

    @F.pandas_udf("array<string>")
    def parse(content: pd.Series) -> pd.Series:
        def one(data):
            try:
                return paragraphs_of_docx(data)
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                return []

        return content.map(one)

    return spark.read.format("binaryFile").load(path).select("path", parse("content").alias("paragraphs"), F.lit("").alias("link"))


def read_encoder(spark: SparkSession, folder: str, items: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(terms: term, idf, vec; docs: id, vec), or None unless the model's ids are the items' in order.

    items: (id, file_id). Vectors are rows of signed bytes; documents' are divided by 127. The raw
    files are read whole: they are one model's, a few bytes for each document.
    """
    info = spark.read.schema("ids array<string>, dim int, vocab array<string>, idf array<float>").option("multiLine", True).json(f"{folder}/modelo.json")
    ids = info.select(F.posexplode("ids").alias("id", "file_id"))
    same = ids.withColumn("id", F.col("id").cast("long")).join(items.select(F.col("id"), F.col("file_id").alias("own")), "id", "full")
    if not same.where("file_id is null or own is null or file_id <> own").isEmpty():
        return None
    dim = info.first()["dim"]

    def vectors(name: str, scale: float) -> DataFrame:
        def split(batches):
            for batch in batches:
                for data in batch["content"]:
                    v = (np.frombuffer(data, np.int8).reshape(-1, dim) / scale).tolist()
                    for at in range(0, len(v), 4096):
                        yield pd.DataFrame({"id": range(at, at + len(v[at : at + 4096])), "vec": v[at : at + 4096]})

        return spark.read.format("binaryFile").load(f"{folder}/{name}").select("content").mapInPandas(split, "id long, vec array<double>")

    words = info.select(F.posexplode(F.arrays_zip("vocab", "idf")).alias("id", "w")).select(F.col("id").cast("long").alias("id"), F.col("w.vocab").alias("term"), F.col("w.idf").cast("double").alias("idf"))
    return words.join(vectors("termos.bin", 1.0), "id").drop("id"), vectors("docs.bin", 127.0)
