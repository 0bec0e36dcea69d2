"""Check XML files: spark-submit tools/validate.py PATH [--wf] [--catalog FILE] [--base URI] [--out DIR]

Every file below PATH is held against its own DTD: the internal subset, and what the
catalog (a JSON object of system or public ids and texts) has for the external one. With
--wf only well-formedness is checked. Diagnostics go to --out as JSON lines, or else the
first of them are printed. The exit status is 1 if there are errors.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators.dtd import dtds_of
from sylva.operators.validate import Validator
from sylva.sources.files import read_files
from sylva.sources.parser import Options
from sylva.sources.store import roundtrip
from sylva.sources.xml import diagnostics, parse_nodes

SHOWN = 100


def check_files(spark: SparkSession, path: str, wf: bool = False, catalog: dict[str, str] | None = None, base: str | None = None) -> DataFrame:
    """(system_id, severity, class, message, entity, line, col) of all files."""
    options = Options(catalog=catalog or {}, base=base)
    docs = roundtrip(read_files(spark, path), "files")
    lost = docs.filter("xml IS NULL").select("system_id", F.lit("error").alias("severity"), F.lit("Other").alias("class"), F.lit("The encoding can't be read").alias("message"), F.lit("[toplevel]").alias("entity"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("col"))
    docs = docs.filter("xml IS NOT NULL")
    found = diagnostics(docs, options)
    if not wf:
        nodes = roundtrip(parse_nodes(docs, options), "nodes")
        found = found.unionByName(Validator(nodes, dtds_of(docs, catalog)).diagnostics().join(nodes.select("doc_id").distinct(), "doc_id", "left_semi"))
    named = found.join(docs.select("doc_id", "system_id"), "doc_id").drop("doc_id")
    return named.unionByName(lost)


def main() -> int:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("path")
    args.add_argument("--wf", action="store_true")
    args.add_argument("--catalog")
    args.add_argument("--base")
    args.add_argument("--out")
    a = args.parse_args()
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found = roundtrip(check_files(spark, a.path, a.wf, json.loads(Path(a.catalog).read_text()) if a.catalog else None, a.base), "found")
    counts = {r["severity"]: r["count"] for r in found.groupBy("severity").count().collect()}
    if a.out:
        found.write.json(a.out)
    else:
        for r in found.orderBy("system_id", "line", "col").limit(SHOWN).collect():
            print(f"{r['system_id']}: in entity {r['entity']}, at line {r['line']}, position {r['col']}: {r['severity'].upper()} ({r['class']}): {r['message']}")
    print(f"{counts.get('error', 0)} errors, {counts.get('warning', 0)} warnings")
    return int(counts.get("error", 0) > 0)


if __name__ == "__main__":
    sys.exit(main())
