"""Hybrid retrieval, batched over many questions: keyword look-up, k-NN, fusion, feedback, threshold, diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.functions.expressions import chunk_key, question_tokens

RRF_K = 60
TOP_K = 7
LEAST_SCORE = 0.15
FALLBACK = 3
MOST_RESULTS = 10
FEEDBACK_TOP, FEEDBACK_SIMILARITY, FEEDBACK_BOOST = 5, 0.6, 0.5
LAMBDA = 0.5
QUERY_BLOCK = 4096  # query vectors held by one task at a time

# Fixed values: (collection, metadata field a token is looked up in, score of a hit).
PROBES = (
    ("data_dictionary", "column", 1.0),
    ("data_dictionary", "original_name", 0.95),
    ("lineage", "source_column", 0.95),
    ("lineage", "silver_column", 0.95),
    ("lineage", "gold_column", 0.90),
    ("ontology", "entity", 0.90),
    ("pbi_lineage", "pbi_column", 0.95),
    ("pbi_lineage", "gold_column", 0.90),
    ("pbi_lineage", "bronze_column", 0.90),
    ("pbi_lineage", "source_column", 0.90),
    ("pbi_catalog", "pbi_column", 0.95),
    ("pbi_catalog", "measure_name", 0.95),
    ("pbi_catalog", "report_name", 0.90),
    ("pbi_catalog", "dashboard_name", 0.90),
)
# Fixed values: (words that ask for all documents of a type, collection, type, score of a hit).
TYPE_WORDS = (
    ("end-to-end e2e pbi powerbi power", "pbi_lineage", "pbi_end_to_end", 0.85),
    ("dashboard dashboards", "pbi_catalog", "pbi_dashboard", 0.90),
    ("report reports", "pbi_catalog", "pbi_report", 0.90),
    ("measure measures kpi dax calculated formula", "pbi_catalog", "pbi_measure", 0.90),
    ("tile tiles", "pbi_catalog", "pbi_dashboard", 0.90),
    ("revenue copay coverage count", "pbi_catalog", "pbi_measure", 0.90),
    ("overview summary catalog available knowledge mesh", "data_dictionary", "catalog_summary", 1.0),
)


def tokens(questions: DataFrame) -> DataFrame:
    """(query_id, token): the distinct candidate identifiers of each question; none for null and empty questions."""
    return questions.where("question is not null").select("query_id", F.explode(question_tokens(F.col("question"))).alias("token"))


def probe_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PROBES)], "probe int, collection string, field string, score double")


def keyword_hits(toks: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, collection, id, document, score): documents whose metadata equal a token of the question.

    An inverted index of (collection, field, value) meets the tokens; entity names
    are looked up capitalised; words for a type fetch all documents of that type.
    A document found in several ways keeps its highest score, and of documents
    with the same first 100 characters one is kept.
    """
    spark = docs.sparkSession
    index = docs.select("collection", "id", "document", F.explode("metadata").alias("field", "value")).join(F.broadcast(probe_table(spark)), ["collection", "field"])
    wanted = toks.withColumn("value", F.col("token")).unionByName(toks.withColumn("value", F.initcap("token"))).distinct()
    by_value = index.join(wanted, "value").where((F.col("field") == "entity") | (F.col("value") == F.col("token"))).select("query_id", "collection", "id", "document", "score")
    kinds = spark.createDataFrame([(w, c, k, x) for ws, c, k, x in TYPE_WORDS for w in ws.split()], "word string, collection string, kind string, score double")
    typed = docs.withColumn("kind", F.element_at("metadata", "type")).join(F.broadcast(kinds), ["collection", "kind"])
    words = toks.select("query_id", F.lower("token").alias("word")).distinct()
    by_type = typed.join(words, "word").select("query_id", "collection", "id", "document", "score")
    both = by_value.unionByName(by_type)
    best = F.row_number().over(Window.partitionBy("query_id", F.substring("document", 1, 100)).orderBy(F.desc("score"), "collection", "id"))
    return both.withColumn("_r", best).where("_r = 1").drop("_r")


def knn(queries: DataFrame, items: DataFrame, k: int = TOP_K, groups: str = "collection") -> DataFrame:
    """(query_id, group, item_id, score, rank): the k nearest items of every query in every group, by cosine.

    ``queries`` has (query_id, embedding), ``items`` (item_id, group, embedding).  The
    query set is taken in blocks; each task holds one block and its share of the
    items, and hands on only its own k best per query and group.  Scores are
    max(0, cosine) to four places; ties go to the smaller item id; rank starts at 0.
    Null vectors are left out, a vector of zeros has cosine 0.
    """
    spark = queries.sparkSession
    good = queries.where("embedding is not null").select("query_id", "embedding")
    n = good.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        part = good.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()  # one block of the stated query set
        if part.empty:
            continue
        matrix = np.array(part["embedding"].tolist(), dtype=np.float64)
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        held = spark.sparkContext.broadcast((part["query_id"].to_numpy(), np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)))

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, unit = held.value
            best: dict = {}
            for batch in batches:
                item = batch.column(0).to_numpy(zero_copy_only=False)
                group = batch.column(1).to_pylist()
                lists = batch.column(2)
                v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(item), -1)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                scores = np.round(np.maximum(0.0, unit @ np.divide(v, size, out=np.zeros_like(v), where=size > 0).T), 4)
                by: dict = {}
                for i, g in enumerate(group):
                    by.setdefault(g, []).append(i)
                for g, at in by.items():
                    s, it = scores[:, at], item[at]
                    if g in best:
                        s, it = np.concatenate([best[g][0], s], 1), np.concatenate([best[g][1], np.broadcast_to(it, (len(ids), len(it)))], 1)
                    else:
                        it = np.broadcast_to(it, (len(ids), len(it)))
                    order = np.lexsort((it, -s), axis=1)[:, :k]
                    best[g] = (np.take_along_axis(s, order, 1), np.take_along_axis(it, order, 1))
            for g, (s, it) in best.items():
                m = s.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, m)), pa.array([g] * (m * len(ids)), pa.string()), pa.array(it.ravel()), pa.array(s.ravel())], names=["query_id", groups, "item_id", "score"]
                )

        local = items.where("embedding is not null").select("item_id", F.col(groups).cast("string").alias(groups), "embedding").mapInArrow(work, f"query_id long, `{groups}` string, item_id long, score double")
        found = local if found is None else found.unionByName(local)
    if found is None:
        found = spark.createDataFrame([], f"query_id long, `{groups}` string, item_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", groups).orderBy(F.desc("score"), "item_id"))
    return found.withColumn("rank", (rank - 1).cast("long")).where(F.col("rank") < k)


def fused(semantic: DataFrame, keyword: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk, rrf_score): reciprocal ranks of the semantic lists plus keyword scores, per chunk.

    ``semantic`` has (query_id, chunk, rank from 0), ``keyword`` (query_id, chunk, score).
    """
    a = semantic.select("query_id", "chunk", (F.lit(1.0) / (F.lit(k) + F.col("rank") + 1)).alias("s"))
    b = keyword.select("query_id", "chunk", F.col("score").alias("s"))
    return a.unionByName(b).groupBy("query_id", "chunk").agg(F.round(F.sum("s"), 4).alias("rrf_score"))


def boosted(results: DataFrame, good_chunks: DataFrame) -> DataFrame:
    """Add 0.5 to chunks that helped with a similar question: good_chunks has (query_id, chunk)."""
    g = good_chunks.select("query_id", "chunk").distinct().withColumn("_good", F.lit(True))
    j = results.join(g, ["query_id", "chunk"], "left")
    return j.select("query_id", "chunk", F.round(F.col("rrf_score") + F.when(F.col("_good"), FEEDBACK_BOOST).otherwise(0.0), 4).alias("rrf_score"), F.coalesce("_good", F.lit(False)).alias("feedback_boosted"))


def helpful_chunks(neighbours: DataFrame, feedback: DataFrame) -> DataFrame:
    """(query_id, chunk) of the nearest approved questions: neighbours has (query_id, item_id, score, rank), feedback (item_id, chunk_ids)."""
    near = neighbours.where((F.col("rank") < FEEDBACK_TOP) & (F.col("score") >= FEEDBACK_SIMILARITY))
    return near.join(feedback, "item_id").select("query_id", F.explode("chunk_ids").alias("chunk")).distinct()


def passed(results: DataFrame) -> DataFrame:
    """Results at or above the threshold; where a question has none, its first three."""
    by_score = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "chunk")
    whole = Window.partitionBy("query_id")
    ok = F.col("rrf_score") >= LEAST_SCORE
    d = results.withColumn("_any", F.max(ok).over(whole)).withColumn("_n", F.row_number().over(by_score))
    return d.where(ok | (~F.col("_any") & (F.col("_n") <= FALLBACK))).drop("_any", "_n")


OVERLAP = ("pbi_table", "pbi_column", "gold_view", "table", "column")


def similarity(a: dict, b: dict) -> float:
    """Overlap of two chunks: collection 0.5, type 0.2 (both absent is equal), 0.1 for each equal key, 0.3 at most."""
    ma, mb = a["metadata"], b["metadata"]
    s = 0.5 * (a["collection"] == b["collection"]) + 0.2 * (ma.get("type") == mb.get("type"))
    return min(1.0, s + min(0.3, 0.1 * sum(1 for k in OVERLAP if ma.get(k) and ma.get(k) == mb.get(k))))


def diverse(chunks: list[dict], most: int = MOST_RESULTS, weight: float = LAMBDA) -> list[int]:
    """Greedy maximal marginal relevance; the first chunk seeds, of equal marks the earlier wins."""
    if not chunks:
        return []
    chosen, rest = [0], list(range(1, len(chunks)))
    nearest = {i: similarity(chunks[i], chunks[0]) for i in rest}
    while rest and len(chosen) < most:
        best = max(rest, key=lambda i: ((1 - weight) * chunks[i]["rrf_score"] - weight * nearest[i], -i))
        rest.remove(best)
        chosen.append(best)
        for i in rest:
            nearest[i] = max(nearest[i], similarity(chunks[i], chunks[best]))
    return chosen


def covered(chunks: list[dict], chosen: list[int], wanted: list[str]) -> list[int]:
    """Give each wanted collection that has a chunk but none chosen the last place, in name order, then order by score again."""
    out = list(chosen)
    for c in sorted(wanted):
        if any(chunks[i]["collection"] == c for i in out):
            continue
        best = next((i for i in range(len(chunks)) if chunks[i]["collection"] == c), None)
        if best is not None and out:
            out[-1] = best
    return sorted(dict.fromkeys(out), key=lambda i: (-chunks[i]["rrf_score"], i))


def selected(results: DataFrame, most: int = MOST_RESULTS, weight: float = LAMBDA, coverage: bool = True) -> DataFrame:
    """Diverse results per question: (query_id, chunk, collection, rrf_score, position).

    ``results`` has (query_id, chunk, collection, metadata, rrf_score).  A question's
    candidates are few (k per collection plus keyword hits), so each question is one group.
    """

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["rrf_score", "chunk"], ascending=[False, True]).reset_index(drop=True)
        chunks = [{"collection": c, "metadata": dict(m) if m is not None else {}, "rrf_score": s} for c, m, s in zip(g["collection"], g["metadata"], g["rrf_score"], strict=True)]
        chosen = diverse(chunks, most, weight)
        if coverage:
            chosen = covered(chunks, chosen, sorted({c["collection"] for c in chunks}))
        out = g.loc[chosen, ["query_id", "chunk", "collection", "rrf_score"]].reset_index(drop=True)
        out["position"] = np.arange(1, len(out) + 1, dtype="int32")
        return out

    return results.select("query_id", "chunk", "collection", "metadata", "rrf_score").groupBy("query_id").applyInPandas(pick, "query_id long, chunk string, collection string, rrf_score double, position int")


MOST_COLLECTIONS = 10_000


def missing_collections(results: DataFrame, collections: list[str]) -> DataFrame:
    """(query_id, collection): collections of the catalog, a bounded list, without a chosen result, for each question."""
    if len(collections) > MOST_COLLECTIONS:
        raise ValueError(f"more than {MOST_COLLECTIONS} collections")
    every = F.array(*[F.lit(c) for c in sorted(set(collections))])
    return results.groupBy("query_id").agg(F.collect_set("collection").alias("got")).select("query_id", F.explode(F.array_except(every, "got")).alias("collection"))


def contexts(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, context): the numbered texts of a question's chunks, with null share, distinct count and samples of dictionary columns."""
    m = F.col("metadata")
    extra = F.when(
        F.element_at(m, "type") == "data_dictionary",
        F.concat_ws(" | ", F.concat(F.lit("Null%: "), F.element_at(m, "null_pct")), F.concat(F.lit("Unique Count: "), F.element_at(m, "unique_count")), F.concat(F.lit("Samples: "), F.element_at(m, "sample_values"))),
    )
    text = F.concat_ws(" | ", F.concat(F.lit("["), F.col("collection"), F.lit("] "), F.col("document")), F.nullif(extra, F.lit("")))
    d = docs.withColumn("chunk", chunk_key(F.col("collection"), F.col("document"))).dropDuplicates(["chunk"]).select("chunk", "document", "metadata")
    lines = chosen.join(d, "chunk").select("query_id", "position", F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), text).alias("line"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("context"))


def hashed_vectors(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """(key, embedding): term counts hashed to a fixed width, for texts without vectors of their own."""
    terms = df.select(key, F.explode(F.split(F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{N}_]+", " ")), " ")).alias("t")).where("t <> ''")
    at = terms.groupBy(key, F.pmod(F.xxhash64("t"), F.lit(size)).cast("int").alias("i")).agg(F.count("*").cast("float").alias("n"))
    g = at.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
    return g.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0).cast("float"))).alias("embedding"))


def sources(chosen: DataFrame, near: DataFrame, hits: DataFrame, good: DataFrame | None = None) -> DataFrame:
    """(query_id, n_chunks, n_semantic, n_keyword, n_boosted): where the chosen chunks of each question came from; a chunk may have come both ways."""
    mark = lambda d, name: d.select("query_id", "chunk").distinct().withColumn(name, F.lit(1))
    j = chosen.select("query_id", "chunk").join(mark(near, "s"), ["query_id", "chunk"], "left").join(mark(hits, "k"), ["query_id", "chunk"], "left")
    j = j.withColumn("b", F.lit(None).cast("int")) if good is None else j.join(mark(good, "b"), ["query_id", "chunk"], "left")
    return j.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.count("s").alias("n_semantic"), F.count("k").alias("n_keyword"), F.count("b").alias("n_boosted"))


def candidates(questions: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nearest chunks, keyword hits) of a batch of questions: (query_id, chunk, rank) and (query_id, chunk, score)."""
    hits = keyword_hits(tokens(questions), docs).withColumn("chunk", chunk_key(F.col("collection"), F.col("document")))
    vectors = hashed_vectors(docs, "item_id", "document").join(docs.select("item_id", "collection"), "item_id")
    near = knn(hashed_vectors(questions, "query_id", "question"), vectors).join(docs.select("item_id", "chunk"), "item_id")
    return near.select("query_id", "chunk", "rank"), hits.select("query_id", "chunk", "score")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("item_id", F.xxhash64("collection", "id")).withColumn("chunk", chunk_key(F.col("collection"), F.col("document")))


def retrieve(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """The whole retrieval for a batch of questions (query_id, question) over documents (collection, id, document, metadata)."""
    from loomlake.session import durable

    docs = durable(keyed(docs))
    near, hits = candidates(questions, docs)
    scores = passed(fused(near, hits))
    full = scores.join(docs.dropDuplicates(["chunk"]).select("chunk", "collection", "metadata"), "chunk")
    return selected(full)
