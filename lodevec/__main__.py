"""python -m lodevec COMMAND PATH ...: administration of collections."""

import argparse
import json

from pyspark.sql import SparkSession

from lodevec.operators.store import Collection
from lodevec.sources import ndjson


def main() -> int:
    p = argparse.ArgumentParser(prog="lodevec")
    sub = p.add_subparsers(dest="command", required=True)
    commands = {
        "info": [], "stats": [], "doctor": [], "put": ["vector"], "search": ["vector"], "export": ["out"], "import": ["source"],
        "upgrade": [], "snapshot": ["out"], "restore": ["out"], "compact": ["out"], "delete": ["id"],
    }
    for name, extra in commands.items():
        c = sub.add_parser(name)
        c.add_argument("path")
        for e in extra:
            c.add_argument(e)
    o = {x: sub.choices[x].add_argument for x in commands}
    o["put"]("--text", default=""), o["put"]("--ts", default=""), o["put"]("--dim", type=int), o["put"]("--metric", default="ip")
    o["search"]("--top-k", type=int, default=5), o["search"]("--from", dest="start", default=""), o["search"]("--to", dest="end", default=""), o["search"]("--candidate-k", type=int, default=0)
    o["export"]("--start", type=int, default=0), o["export"]("--end", type=int, default=0)
    o["import"]("--chunk-size", type=int, default=1024), o["import"]("--checkpoint", default=""), o["import"]("--resume", action="store_true"), o["import"]("--dim", type=int)
    o["upgrade"]("--apply", action="store_true"), o["restore"]("--force", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName("lodevec").getOrCreate()
    rows = lambda d: [print(x) for x in d.toJSON().collect()]
    if a.command == "upgrade":
        print(json.dumps({"changes": Collection.upgrade(spark, a.path, a.apply), "applied": a.apply}))
        return 0
    if a.command == "restore":
        rows(Collection.restore(spark, a.path, a.out, a.force).stats())
        return 0
    c = Collection(spark, a.path, getattr(a, "dim", None), getattr(a, "metric", "ip"))  # an existing collection keeps its own metric
    if a.command in ("info", "stats"):
        s = c.stats()
        rows(s.select("dim", "metric", "count", "count_live") if a.command == "info" else s)
    elif a.command == "doctor":
        checks = c.doctor()
        rows(checks)
        return int(checks.where("NOT ok").count() > 0)
    elif a.command == "put":
        print(c.put(ndjson.read_vector_file(a.vector, c.dim), a.text, a.ts))
    elif a.command == "search":
        q = ndjson.read_vector_file(a.vector, c.dim)
        rows(c.search_ts_range(q, a.top_k, a.start, a.end, a.candidate_k) if a.start or a.end else c.search(q, a.top_k))
    elif a.command == "export":
        ndjson.write_ndjson(c.rows(), a.out, a.start, a.end)
    elif a.command == "import":
        print(ndjson.import_ndjson(c, a.source, a.chunk_size, a.checkpoint, a.resume))
    elif a.command == "snapshot":
        print(json.dumps(c.snapshot(a.out)))
    elif a.command == "compact":
        rows(c.compact(a.out).stats())
    elif a.command == "delete":
        print(c.delete(int(a.id)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
