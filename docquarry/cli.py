"""Batch ingestion: ``spark-submit -m docquarry.cli --dir FOLDER --store PATH``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .ingest import batch_totals, ingest_directory
from .operators.store import ChunkStore


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Ingest PDF, DOCX and Markdown files")
    where = parser.add_mutually_exclusive_group(required=True)
    where.add_argument("--dir", help="folder to ingest")
    where.add_argument("--file", help="single file to ingest")
    parser.add_argument("--store", required=True, help="path of the chunk store")
    parser.add_argument("--project_id")
    parser.add_argument("--term")
    parser.add_argument("--year", type=int)
    parser.add_argument("--report", help="folder for the JSON report; printed if missing")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    override = {"project_id": given.project_id, "term": given.term, "year": given.year}
    report = ingest_directory(ChunkStore(spark, given.store), given.dir or given.file, override=override)
    if given.report:
        report.write.mode("overwrite").json(given.report)
    else:
        for row in report.toJSON().toLocalIterator():
            print(row)
        print(json.dumps(batch_totals(report).first().asDict()))


if __name__ == "__main__":
    main()
