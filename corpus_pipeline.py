"""From raw documents to a training mix: five stages over the operators of ``cutline.llm``.

Every stage but the last returns the columns of ``documents``, less the rows it rejects:

1. language ID: rows without any letter (``und``) or whose best language has a posterior under
   one half go;
2. toxicity: rows with a calibrated score of 0.7 or more go;
3. MinHash near-dedup: of each group of near copies the row with the smallest id stays;
4. benchmark decontamination: rows that leak an item go;
5. mixing: each row that the mix takes, with its words, its source's target and the words taken.

Stages run one after another; each result is written as Parquet in the shared folder and reread,
so a lost executor never repeats an earlier stage. Rows that share an id share its decisions;
null ids are kept by the near-dedup stage, as no one can tell which of them to keep.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm import decontam, langid, mixing, neardup, toxicity
from cutline.session import shared_dir, table

MIN_LANGUAGE_SCORE = 0.5
TOXIC_SCORE = 0.7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, F.lit(True))
    found = langid.identify(docs, "text", model, "_lang_pred", "_lang_score")
    return found.filter((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, model, score_col="_toxic").filter(F.col("_toxic") < TOXIC_SCORE).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, width=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).filter(F.col("taken") > 0)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
]

ORACLE_SQL = None
"""Trained classifiers cannot be said in SQL; the tests hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for number, (name, stage) in enumerate(STAGES):
        path = os.path.join(folder, f"{number}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
