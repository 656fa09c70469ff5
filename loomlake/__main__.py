"""python -m loomlake run NAME FOLDER [--rows N] | names | pipeline FOLDER DATABASE | evaluate FOLDER CASES OUTPUT [--quick] | ask FOLDER [--stream] [--feedback LOG] QUESTION..."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from loomlake.plans import data_queries, reference_queries

    queries = reference_queries.QUERIES | data_queries.QUERIES
    if args[:1] == ["names"]:
        print("\n".join(queries))
        return 0
    if len(args) < 3 or args[0] not in ("run", "ask", "pipeline", "evaluate"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("loomlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args[0] == "run":
        if args[1] not in queries:
            print(f"no query {args[1]}")
            return 2
        n = int(args[args.index("--rows") + 1]) if "--rows" in args else 20
        queries[args[1]](spark, args[2]).show(n, truncate=False)
        return 0
    if args[0] == "pipeline":
        from loomlake.plans.pipeline import run

        for step, what in run(spark, args[1], args[2]).items():
            print(f"{step}: {what}")
        return 0
    docs = reference_queries._catalog_docs(spark, args[1])
    if args[0] == "evaluate":
        from loomlake.operators import evaluation
        from loomlake.session import durable

        if len(args) < 4:
            print(__doc__)
            return 2
        cases = evaluation.read_cases(spark, args[2])
        if "--quick" in args:
            cases = evaluation.subset(cases.withColumnRenamed("case_id", "place")).withColumnRenamed("place", "case_id")
        results = durable(evaluation.evaluated(cases, docs))
        print(evaluation.report(results))
        evaluation.saved(results, args[3])
        return 0
    from loomlake.operators import ask

    rest, log = args[2:], None
    if "--feedback" in rest:
        at = rest.index("--feedback")
        log, rest = rest[at + 1], rest[:at] + rest[at + 2 :]
    words = [w for w in rest if w != "--stream"]
    r = ask.answered(spark.createDataFrame([(1, " ".join(words))], "query_id long, question string"), docs).first()
    for piece in r["answer"].split(" ") if "--stream" in rest else [r["answer"]]:
        print(piece, end=" " if "--stream" in rest else "", flush=True)
    print(f"\n({r['route']}, {r['quality']})")
    if log is not None:
        said = input("Was this helpful? [y/n] ").strip().lower()
        if said in ("y", "yes", "n", "no"):
            ask.record_feedback(spark, log, "1", r["question"], r["chunk_ids"], said[0] == "y")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
