"""Command line: ``python -m docloom process|query|load``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from docloom.plans.pipeline import Config, Pipeline
from docloom.session import local_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docloom")
    parser.add_argument("command", choices=["process", "query", "load"])
    parser.add_argument("--input")
    parser.add_argument("--query")
    parser.add_argument("--chunks-dir")
    parser.add_argument("--config")
    parser.add_argument("--overwrite", action="store_true")
    args = parser.parse_args(argv)
    values = json.loads(Path(args.config).read_text()) if args.config else {}
    if args.chunks_dir:
        values["chunks_dir"] = args.chunks_dir
    if args.overwrite:
        values["overwrite"] = True
    spark = local_session()
    pipeline = Pipeline(spark, Config.of(values))
    if args.command == "process":
        if not args.input:
            parser.error("process needs --input")
        print(json.dumps({"chunks": pipeline.process_documents(args.input).count()}))
        return 0
    n = pipeline.load_chunks_from_files().count()
    if args.command == "load":
        print(json.dumps({"chunks": n}))
        return 0
    if not args.query:
        parser.error("query needs --query")
    asked = spark.createDataFrame([(1, args.query)], "query_id long, query string")
    for row in pipeline.query(asked, return_chunks=True).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
