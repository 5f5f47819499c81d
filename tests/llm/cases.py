"""Rows that every text operator must take: nulls, empty and blank texts, repeated rows, long texts, clashing names."""

from __future__ import annotations

LONG = " ".join(f"word{k % 977} and, The Other{k % 13}" for k in range(6000))
HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
EDGE = [
    (1, "One two three four five six seven eight nine ten eleven.", "en"),
    (1, "One two three four five six seven eight nine ten eleven.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t \n", "fr"),
    (5, "word", "fr"),
    (6, LONG, "en"),
    (7, "ONE two three four five six seven eight nine ten eleven.", None),
    (None, "a row without an id, but with some words in it for all that", "en"),
    (None, None, None),
    (8, "日本語 のテキスト 😀 é é ", "fr"),
    (9, f'token = "{HEX}" and more after it', "en"),
    (-5, "One two three four five six seven eight nine ten eleven.", "en"),
]
SCHEMA = (
    "doc_id long, text string, lang string, _id string, id string, label int, row int, rep int, digest int, block int, "
    "features string, spans string, component_id long, _shard int, score string, held int"
)


def edge(spark):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, 4, 5, "f", "s", 7, 8, "q", 9) for r in EDGE], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
