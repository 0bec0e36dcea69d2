"""Time the reader, validation and XPath on made-up plays: python tools/measure.py [PLAYS]

One play of about the size of a printed one, by itself, and then PLAYS of them (200 by
default) in one table: megabytes and nodes a second, after a run that warms up.
"""

from __future__ import annotations

import json
import os
import random
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession

from sylva.operators import events as ev
from sylva.operators.dtd import parse_dtd
from sylva.operators.validate import Validator
from sylva.plans.xpath import evaluate
from sylva.sources.store import roundtrip, sweep
from sylva.sources.xml import parse_events, parse_nodes

DTD = """<!ELEMENT play (title, act+)><!ELEMENT act (title, scene+)><!ELEMENT scene (title, (speech | direction)+)>
<!ELEMENT speech (speaker, line+)><!ELEMENT title (#PCDATA)><!ELEMENT speaker (#PCDATA)><!ELEMENT line (#PCDATA)>
<!ELEMENT direction (#PCDATA)><!ATTLIST speech n CDATA #REQUIRED>"""


def play(seed: int) -> str:
    """Five acts of five scenes with 28 speeches each."""
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfghlmnprstvw')}{rng.choice(['a', 'e', 'i', 'o', 'ou'])}{rng.choice(['', 'n', 'r', 'st', 'ld'])}" for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    scenes = []
    for a in range(5):
        made = []
        for s in range(5):
            parts = [f"<title>Scene {s}. {say(4)}</title>"]
            for n in range(28):
                parts.append(f'<speech n="{n}"><speaker>{say(1).upper()}</speaker>' + "".join(f"<line>{say(7)}</line>" for _ in range(rng.randint(1, 6))) + "</speech>")
                if n % 7 == 0:
                    parts.append(f"<direction>{say(3)}</direction>")
            made.append(f"<scene>{''.join(parts)}</scene>")
        scenes.append(f"<act><title>Act {a}</title>{''.join(made)}</act>")
    return f"<play><title>{say(3)}</title>{''.join(scenes)}</play>"


def timed(run) -> tuple[float, object]:
    began = time.time()
    out = run()
    return time.time() - began, out


def measure(spark: SparkSession, docs: DataFrame, mb: float) -> dict:
    dtd = parse_dtd(DTD, root="play")
    nodes = roundtrip(parse_nodes(docs), "nodes")
    n = nodes.count()
    jobs = {
        "events": lambda: parse_events(docs).write.format("noop").mode("overwrite").save(),
        "nodes": lambda: parse_nodes(docs).write.format("noop").mode("overwrite").save(),
        "validate": lambda: Validator(nodes, dtd).all().count(),
        "write": lambda: ev.write(parse_events(docs)).write.format("noop").mode("overwrite").save(),
        "//speech[@n='3']/line": lambda: evaluate(nodes, "//speech[@n='3']/line").count(),
        "//scene//line": lambda: evaluate(nodes, "//scene//line").count(),
        "count(//line/ancestor::act)": lambda: evaluate(nodes, "count(//line/ancestor::act)").count(),
    }
    out = {"mb": round(mb, 2), "n_nodes": n}
    for name, job in jobs.items():
        took, _ = timed(job)
        out[name] = {"s": round(took, 2), "mb_s": round(mb / took, 2), "nodes_s": round(n / took)}
    return out


def main() -> None:
    many, cpus = int(sys.argv[1]) if len(sys.argv) > 1 else 200, os.environ.get("BENCH_CPUS", "8")
    build = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
    spark = build.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    made = {"one play": [play(0)], f"{many} plays": [play(k) for k in range(many)]}
    for name in ("one play", *made):
        rows = spark.createDataFrame(list(enumerate(made[name])), "doc_id long, xml string").repartition(int(cpus) if len(made[name]) > 1 else 1)
        docs = roundtrip(rows, "plays")
        print(json.dumps({"of": name, "cpus": int(cpus)} | measure(spark, docs, sum(map(len, made[name])) / 1e6)), flush=True)
        sweep(spark)


if __name__ == "__main__":
    main()
