"""process, info, index, query, stats and serve on the command line."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docweft import config
from docweft.operators import vectors
from docweft.plans import pipelines
from docweft.sources import files


def session() -> SparkSession:
    return SparkSession.builder.appName("docweft").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docweft")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("process", "info", "index"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--format")
        c.add_argument("--output")
        c.add_argument("--min-quality", type=int, default=0)
    c = sub.add_parser("query")
    c.add_argument("question")
    c.add_argument("--top-k", type=int)
    c.add_argument("--threshold", type=float)
    c.add_argument("--document-id")
    c.add_argument("--retrieve-only", action="store_true")
    sub.add_parser("stats")
    c = sub.add_parser("serve")
    c.add_argument("--port", type=int, default=8000)
    a = p.parse_args(argv)
    cfg, spark = config.load(a.config), session()
    if a.command == "process":
        ex = replace(cfg.export, format=a.format or cfg.export.format, output_dir=a.output or cfg.export.output_dir)
        done, path = pipelines.run(spark, a.path, replace(cfg, export=ex))
        row = done.summary().first().asDict()
        print(json.dumps(row | {"output": path}))
        return int(row["failed"] > 0)
    if a.command == "info":
        files.group_by_extension(files.discover(spark, a.path)).show(truncate=False)
    elif a.command == "index":
        print(json.dumps({"total_indexed": pipelines.index(spark, a.path, cfg, a.min_quality)}))
    elif a.command == "stats":
        print(json.dumps(pipelines.stats(spark, cfg)))
    elif a.command == "serve":
        from docweft import serve

        serve.serve(spark, cfg, a.port)
    else:
        records = vectors.Store(spark, cfg.store.path, cfg.store.collection).read()
        if records is None:
            print("nothing is indexed", file=sys.stderr)
            return 1
        q = spark.createDataFrame([(0, a.question)], "query_id int, question string")
        more = {"top_k": a.top_k, "threshold": a.threshold, "document_id": a.document_id}
        out = pipelines.retrieve(records, q, cfg, **more).orderBy("rank") if a.retrieve_only else pipelines.answer(records, q, cfg, **more).select(F.col("question"), F.col("answer"))
        for r in out.toJSON().collect():
            print(r)
    return 0


if __name__ == "__main__":
    sys.exit(main())
