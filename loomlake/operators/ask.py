"""Questions end to end: retrieve, route, answer through a hook, verify, log; and what users say about answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.functions.expressions import chunk_key, invalid_citations, quality_band, route, short_id
from loomlake.operators.retrieval import contexts, retrieve
from loomlake.session import durable
from loomlake.sources.stores import append_log, read_log

#: A generator takes (route, context, question) and gives an answer. Without one, the context's first line is the answer.
Generator = Callable[[str, str, str], str]
KEPT_FEEDBACK = 100
FEEDBACK = "query_id string, question string, chunk_ids array<string>, helpful boolean, at double"
NO_ANSWER = "Nothing in the catalog answers this."


def answered(questions: DataFrame, docs: DataFrame, generate: Generator | None = None) -> DataFrame:
    """(query_id, question, route, answer, quality, citations_valid, chunk_ids) for a batch of (query_id, question).

    Retrieval and checks are one plan over all questions.  A generator, if given,
    is called where the rows are, once for each question with a context.
    """
    picked = durable(retrieve(questions, docs))
    texts = contexts(picked, docs)
    ids = picked.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk"))), lambda x: x["chunk"]).alias("chunk_ids"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "rrf_score"))), lambda x: x["rrf_score"]).alias("scores"),
    )
    full = questions.join(texts, "query_id", "left").join(ids, "query_id", "left").withColumn("route", route(F.col("question")))
    if generate is None:
        full = full.withColumn("answer", F.coalesce(F.substring_index("context", "\n", 1), F.lit(NO_ANSWER)))
    else:

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                said = [generate(w, c, q) if c else NO_ANSWER for w, c, q in zip(b["route"], b["context"], b["question"], strict=True)]
                yield pd.DataFrame({"query_id": b["query_id"], "answer": said})

        said = durable(full.select("query_id", "route", F.coalesce("context", F.lit("")).alias("context"), "question").mapInPandas(work, "query_id long, answer string"))
        full = full.join(said, "query_id")
    bad = invalid_citations(F.col("answer"), F.coalesce(F.size("chunk_ids"), F.lit(0)))
    return full.select(
        "query_id", "question", "route", "answer", quality_band(F.col("scores")).alias("quality"), (F.size(bad) == 0).alias("citations_valid"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids")
    )


RULES = (
    "Answer from the numbered context alone; say so where it does not hold the answer.",
    "Put the number of its source in brackets behind every statement.",
    "Name tables and columns as they are written, with the layer they belong to.",
    "For lineage give every hop from the source to the report.",
    "Finish with a list of the sources used.",
)


def prompt(question: str, context: str) -> str:
    """What a generator sends to a model: the rules, the numbered context and the question."""
    return "\n".join([*(f"{i}. {r}" for i, r in enumerate(RULES, 1)), "", "Context:", context, "", "Question: " + question])


def grounded(answers: DataFrame, docs: DataFrame, judge) -> DataFrame:
    """(query_id, grounded, details): a judge's word on whether the chunks bear an answer out; false without chunks."""
    texts = docs.withColumn("chunk", chunk_key(F.col("collection"), F.col("document"))).dropDuplicates(["chunk"]).select("chunk", "document")
    shown = answers.select("query_id", F.explode("chunk_ids").alias("chunk")).join(texts, "chunk").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("document")), "\n").alias("context"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [judge("grounded", q, c, a) if c else "no sources" for q, c, a in zip(b["question"], b["context"], b["answer"], strict=True)]
            yield pd.DataFrame({"query_id": b["query_id"], "details": said})

    asked = answers.join(shown, "query_id", "left").select("query_id", "question", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("answer", F.lit("")).alias("answer"))
    said = asked.mapInPandas(work, "query_id long, details string")
    return said.select("query_id", F.contains(F.upper("details"), F.lit("GROUNDED")).alias("grounded"), "details")


def logged(answers: DataFrame, path: str) -> None:
    """Append a batch of answers to the query log, with ids that depend on the question alone."""
    append_log(answers.select(F.lit("query").alias("type"), short_id(F.col("question")).alias("log_id"), "query_id", "question", "route", "quality", "citations_valid"), path)


def record_feedback(spark: SparkSession, path: str, query_id: str, question: str, chunk_ids: list[str], helpful: bool) -> None:
    """Append what a user said about the chunks shown; nothing is looked up again."""
    append_log(spark.createDataFrame([(query_id, question, chunk_ids, helpful, time.time())], FEEDBACK), path)


def approved(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, question, chunk_ids): the last hundred helpful answers, the newest of each question."""
    said = read_log(spark, path, FEEDBACK).where("helpful")
    last = said.orderBy(F.desc("at"), "query_id").limit(KEPT_FEEDBACK)
    one = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("at"), "query_id"))
    return last.withColumn("_r", one).where("_r = 1").select(F.xxhash64("question").alias("item_id"), "question", "chunk_ids")
