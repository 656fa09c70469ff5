"""Quality of retrieval: metrics per case, averages, breakdown by domain; a hook for outside judges."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions.expressions import chunk_key, clamp01, utc_stamp
from loomlake.session import durable
from loomlake.sources.stores import write_artifact

#: A judge takes (kind, question, text, other) and answers in words, as ``word_judge`` does; one that asks a model is given from outside.
Judge = Callable[[str, str, str, str], str]


def says_yes(answer: Column) -> Column:
    return F.contains(F.upper(answer), F.lit("YES"))


def says_grounded(answer: Column) -> Column:
    """Any answer with the word counts, NOT GROUNDED too."""
    return F.contains(F.upper(answer), F.lit("GROUNDED"))


def parsed_score(text: Column) -> Column:
    """A number between 0 and 1; 0.5 where there is none."""
    return clamp01(F.coalesce(text.try_cast("double"), F.lit(0.5)))


def precision(judged: DataFrame) -> DataFrame:
    """(case_id, precision) from (case_id, relevant): the share of relevant chunks; 0 without chunks (a null verdict)."""
    return judged.groupBy("case_id").agg(F.coalesce(F.avg(F.col("relevant").cast("double")), F.lit(0.0)).alias("context_precision"))


def recall(expected: Column, got: Column) -> Column:
    """The share of expected collections that were found; 1 where none is expected; repeats in ``expected`` count."""
    n = F.coalesce(F.size(expected), F.lit(0))
    found = F.size(F.filter(expected, lambda x: F.array_contains(F.coalesce(got, F.array().cast("array<string>")), x)))
    return F.when(n <= 0, F.lit(1.0)).otherwise(found / n)


def faithfulness(answer: Column, chunks: Column, grounded: Column) -> Column:
    """1 for a grounded answer, 0 without chunks, without an answer, or for an ungrounded one."""
    return F.when((F.coalesce(chunks, F.lit(0)) <= 0) | (F.coalesce(F.length(answer), F.lit(0)) == 0), 0.0).otherwise(F.when(grounded, 1.0).otherwise(0.0))


METRICS = ("context_precision", "context_recall", "faithfulness", "answer_relevancy")


def averages(cases: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row: the mean of each metric to two places; zeros for no cases."""
    return cases.agg(F.count("*").alias("n_cases"), *[F.coalesce(F.round(F.avg(m), 2), F.lit(0.0)).alias(m) for m in metrics])


def by_domain(cases: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Per domain: cases and the mean of the metrics, each rounded to two places first; a missing domain is ``unknown``."""
    return cases.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n_cases"), *[F.round(F.avg(F.round(m, 2)), 4).alias(m) for m in metrics]).orderBy("domain")


def subset(cases: DataFrame, indexes: tuple[int, ...] = (0, 3, 6, 8, 12)) -> DataFrame:
    """The cases at the given places (column ``place``), where they exist."""
    return cases.where(F.col("place").isin(*indexes))


# ---------------------------------------------------------------- a run over cases

CASES = "question string, ground_truth string, expected_collections array<string>, domain string"
PREVIEW, QUESTION_WIDTH = 200, 40


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, question, ground_truth, expected_collections, domain) of a JSON list; ids count from 0 in its order."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<struct<{CASES.replace(' string', ':string').replace(' array', ':array')}>>")).alias("c"))
    found = rows.select("c.*").collect()  # cases are written by hand
    return spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "case_id long, " + CASES)


def _long_words(text: str | None) -> set[str]:
    return {w for w in re.findall(r"\w+", (text or "").casefold()) if len(w) > 3}


def word_judge(kind: str, question: str, text: str, other: str) -> str:
    """A judge without a model, by common words of more than three letters.

    relevant: whether a chunk (``text``) has a word of the expected answer
    (``other``); grounded: whether all words of the answer (``other``) stand in the
    chunks (``text``); score: the share of the expected answer's words (``other``)
    that the answer (``text``) has.
    """
    have, want = _long_words(text), _long_words(other)
    if kind == "relevant":
        return "YES" if have & want else "NO"
    if kind == "grounded":
        return "GROUNDED" if want <= have else "unsupported: " + " ".join(sorted(want - have))
    return str(len(have & want) / len(want)) if want else "1.0"


def judged(cases: DataFrame, judge: Judge = word_judge) -> DataFrame:
    """Verdicts of a judge, case by case: (case_id, verdicts of the chunks, grounding, score) for (case_id, question, ground_truth, answer, documents)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                chunks = [] if r.documents is None else list(r.documents)
                answer, truth = r.answer or "", r.ground_truth or ""
                said = [judge("relevant", r.question, c[:500], truth) for c in chunks]
                grounding = judge("grounded", r.question, "\n".join(chunks), answer) if chunks and answer else ""
                out.append((r.case_id, said, grounding, judge("score", r.question, answer[:1000], truth) if answer else "0.0"))
            yield pd.DataFrame(out, columns=["case_id", "verdicts", "grounding", "score"])

    return cases.select("case_id", "question", "ground_truth", "answer", "documents").mapInPandas(work, "case_id long, verdicts array<string>, grounding string, score string")


def evaluated(cases: DataFrame, docs: DataFrame, judge: Judge = word_judge, generate=None) -> DataFrame:
    """Every case retrieved, answered, checked and judged: one row per case with its four metrics."""
    from loomlake.operators.ask import answered

    asked = cases.select(F.col("case_id").alias("query_id"), "question")
    answers = durable(answered(asked, docs, generate).withColumnRenamed("query_id", "case_id").drop("question"))
    texts = docs.withColumn("chunk", chunk_key(F.col("collection"), F.col("document"))).dropDuplicates(["chunk"]).select("chunk", "collection", "document")
    shown = (
        answers.select("case_id", F.posexplode("chunk_ids").alias("place", "chunk")).join(texts, "chunk").groupBy("case_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "document"))), lambda x: x["document"]).alias("documents"), F.array_sort(F.collect_set("collection")).alias("collections_hit"))
    )
    none = F.array().cast("array<string>")
    full = durable(cases.join(answers, "case_id").join(shown, "case_id", "left").withColumns({c: F.coalesce(c, none) for c in ("documents", "collections_hit")}))
    j = full.join(judged(full, judge), "case_id")
    yes = F.size(F.filter("verdicts", lambda v: says_yes(v)))
    n = F.size("documents")
    return j.select(
        "case_id", "question", F.coalesce("domain", F.lit("unknown")).alias("domain"), "ground_truth",
        F.round(F.when(n > 0, yes / n).otherwise(0.0), 2).alias("context_precision"), F.round(recall(F.col("expected_collections"), F.col("collections_hit")), 2).alias("context_recall"),
        faithfulness(F.col("answer"), n, says_grounded(F.col("grounding"))).alias("faithfulness"), F.round(F.when(F.length("answer") > 0, parsed_score(F.col("score"))).otherwise(0.0), 2).alias("answer_relevancy"),
        n.alias("chunks_retrieved"), "collections_hit", "expected_collections", "citations_valid", "route", F.substring("answer", 1, PREVIEW).alias("answer_preview"),
    )


def report(results: DataFrame) -> str:
    """The run as a table in text: one line per case, the averages, and the domains."""
    line = lambda label, values: f"{label:<{QUESTION_WIDTH + 2}}" + "".join(f"{v:>8.2f}" for v in values)
    cut = lambda q: q if len(q) <= QUESTION_WIDTH else q[: QUESTION_WIDTH - 3] + "..."
    head = f"{'Question':<{QUESTION_WIDTH + 2}}" + "".join(f"{x:>8}" for x in ("Prec", "Recall", "Faith", "Relev"))
    rows = [line(cut(r["question"]), [r[m] for m in METRICS]) for r in results.orderBy("case_id").collect()]  # cases are written by hand
    mean = averages(results).first()
    domains = [line(f"{r['domain']} ({r['n_cases']})", [r[m] for m in METRICS]) for r in by_domain(results).collect()]
    rule = "-" * len(head)
    return "\n".join([head, rule, *rows, rule, line("AVERAGE", [mean[m] for m in METRICS]), rule, *domains])


def saved(results: DataFrame, path: str) -> None:
    """The results and their averages as JSON artifacts below ``path``, with the time of the run (UTC)."""
    write_artifact(results, f"{path}/results.json")
    write_artifact(averages(results).withColumn("timestamp", utc_stamp(F.current_timestamp())), f"{path}/averages.json")
