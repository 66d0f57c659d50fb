"""Vector collections: Parquet files under a chain of commit manifests.

A commit stages its files under a directory of its own and then publishes `_commits/N.json` by an
atomic create; readers see published commits only, so a crash leaves files nobody reads. Ids are
dense, from 0 in commit order, and never reused. Deletes are tombstone files; a live read is an
anti join. One writer wins a commit number, another gets a ConflictError: manifests are published by
a hard link on a local file system and by a rename that doesn't overwrite elsewhere, which HDFS makes
atomic. An object store without such a rename needs a single writer.

`build_index` keeps inverted lists beside the commits (`ivf`): a search with nprobe reads the nearest
cells and the rows put since, without deleted ones.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Sequence

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodevec.functions import vectors
from lodevec.operators import ivf, search

FORMAT = 2
DTYPES = ("float32", "float16", "int8")
SCHEMA = "id bigint, vector array<float>, text string, ts string"


class ConflictError(RuntimeError):
    """Another writer published this commit first."""


class QuotaError(RuntimeError):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def check_quota(live: int, adding: int, most: int, kind: str = "vectors") -> None:
    """Exactly at the limit is allowed; 0 or less means no limit."""
    if most > 0 and live + adding > most:
        raise QuotaError(kind, f"{live} + {adding} {kind} exceed the limit of {most}")


class Files:
    """The few file operations needed, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.Path, self.root = jvm.org.apache.hadoop.fs.Path, root
        self.fs = self.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.jvm, self.gateway = jvm, spark.sparkContext._gateway

    def _local(self, path):
        return self.jvm.java.io.File(path.toUri().getPath()).toPath()

    def at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.Path(self.at(*parts)))

    def list(self, *parts: str) -> list[str]:
        p = self.Path(self.at(*parts))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, *parts: str) -> str:
        s = self.fs.open(self.Path(self.at(*parts)))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def publish(self, text: str, *parts: str) -> None:
        """Create a file that must not exist; its content is whole as soon as its name is there, and one writer wins."""
        target, tmp = self.Path(self.at(*parts)), self.Path(self.at(*parts[:-1], f".{uuid.uuid4().hex}"))
        s = self.fs.create(tmp, False)
        s.write(bytearray(text.encode()))
        s.close()
        try:
            if self.fs.getScheme() == "file":
                self.jvm.java.nio.file.Files.createLink(self._local(target), self._local(tmp))
            else:
                rename = self.jvm.org.apache.hadoop.fs.Options.Rename
                options = self.gateway.new_array(rename, 1)
                options[0] = rename.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.fs.getConf()).rename(tmp, target, options)
        except Py4JJavaError as e:
            name = e.java_exception.getClass().getSimpleName()
            if name != "FileAlreadyExistsException":
                raise
            raise ConflictError(self.at(*parts)) from None
        finally:
            self.fs.delete(tmp, False)

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.Path(self.at(*parts)), True)


def _counts_failures(name: str):
    def wrap(f):
        @functools.wraps(f)
        def run(self, *args, **how):
            try:
                return f(self, *args, **how)
            except Exception:
                self.counters[name + "_failed"] += 1
                raise

        return run

    return wrap


class Collection:
    """A transactional table (id, vector, text, ts)."""

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None, metric: str = "ip", dtype: str = "float32", max_vectors: int = 0):
        self.spark, self.path, self.files, self.max_vectors = spark, path, Files(spark, path), max_vectors
        self.counters = dict.fromkeys(("put", "put_failed", "put_batch", "put_batch_failed", "delete", "delete_failed", "update", "update_failed", "search", "search_failed", "search_ts", "search_ts_failed", "sync", "compact"), 0)
        if metric not in vectors.METRICS or dtype not in DTYPES:
            raise ValueError(f"metric is one of {vectors.METRICS}, dtype one of {DTYPES}")
        if not self.files.exists("_commits", "0.json"):
            if not dim or dim <= 0:
                raise ValueError("a new collection needs dim > 0")
            self._publish(0, {"format_version": FORMAT, "dim": dim, "metric": metric, "dtype": dtype, "next_id": 0, "deleted": 0, "rows": [], "tombstones": [], "scale": 1.0})
        self.state = self._latest()
        if dim and dim != self.state["dim"]:
            raise ValueError(f"the collection's dim is {self.state['dim']}, not {dim}")
        self.dim, self.metric, self.dtype = self.state["dim"], self.state["metric"], self.state["dtype"]

    # ------------------------------------------------------------ commits

    def _latest(self) -> dict:
        n = max(int(f[:-5]) for f in self.files.list("_commits") if f.endswith(".json") and f[:-5].isdigit())
        return json.loads(self.files.read("_commits", f"{n}.json")) | {"commit": n}

    def _publish(self, n: int, state: dict) -> None:
        self.files.publish(json.dumps({k: v for k, v in state.items() if k != "commit"}), "_commits", f"{n}.json")

    def _commit(self, rows: DataFrame | None = None, n_rows: int = 0, dead: DataFrame | None = None, n_dead: int = 0, external: DataFrame | None = None, mark: tuple[str, int] | None = None, **more) -> dict:
        """Stage files, then publish: readers get all of a commit (rows, deletes, external ids, a stream's progress) or none."""
        s, tag = dict(self.state) | more, uuid.uuid4().hex
        if external is not None:
            external.select("external", "id").write.parquet(self.files.at("external", tag))
            s["external"] = [*s.get("external", []), tag]
        if mark is not None:
            s["streams"] = s.get("streams", {}) | {mark[0]: mark[1]}
        if rows is not None:
            scale = 1.0
            if self.dtype == "int8":
                scale = float(rows.agg(vectors.int8_scale_of(F.col("vector")).alias("s")).first()["s"] or 1.0)
                rows = rows.withColumn("vector", vectors.quantize_int8(F.col("vector"), F.lit(scale)))
            elif self.dtype == "float16":
                rows = rows.withColumn("vector", vectors.to_float16(F.col("vector")))
            rows.write.parquet(self.files.at("data", tag))
            s["rows"] = [*s["rows"], {"dir": tag, "scale": scale}]
            s["scale"] = max(s["scale"], scale)
            s["next_id"] += n_rows
        if dead is not None:
            dead.select("id").write.parquet(self.files.at("tombstones", tag))
            s["tombstones"] = [*s["tombstones"], tag]
            s["deleted"] += n_dead
        self._publish(self.state["commit"] + 1, s)
        self.state = s | {"commit": self.state["commit"] + 1}
        return self.state

    # ------------------------------------------------------------ reads

    def all_rows(self) -> DataFrame:
        """Every row, tombstoned ones included, with decoded vectors. Each commit's own scale decodes it."""
        parts = []
        for scale in dict.fromkeys(r["scale"] for r in self.state["rows"]):
            d = self.spark.read.parquet(*(self.files.at("data", r["dir"]) for r in self.state["rows"] if r["scale"] == scale))
            if self.dtype == "int8":
                d = d.withColumn("vector", vectors.dequantize_int8(F.col("vector"), F.lit(scale)))
            elif self.dtype == "float16":
                d = d.withColumn("vector", vectors.from_float16(F.col("vector")))
            parts.append(d)
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def tombstones(self) -> DataFrame:
        if not self.state["tombstones"]:
            return self.spark.createDataFrame([], "id bigint")
        return self.spark.read.parquet(*(self.files.at("tombstones", t) for t in self.state["tombstones"]))

    def rows(self) -> DataFrame:
        """Live rows."""
        return self._live(self.all_rows())

    def raw_vectors(self) -> DataFrame:
        """Vectors of all rows in id order; float32 collections only."""
        d = self.all_rows() if self.dtype == "float32" else self.spark.createDataFrame([], SCHEMA)
        return d.select("id", "vector").orderBy("id")

    def count(self) -> int:
        return self.state["next_id"]

    def count_live(self) -> int:
        return max(0, self.state["next_id"] - self.state["deleted"])

    @_counts_failures("search")
    def search(self, query: Sequence[float], k: int = 5, nprobe: int = 0) -> DataFrame:
        """The k nearest live rows: exact, or with nprobe by the index (see build_index)."""
        self._check(query)
        self.counters["search"] += 1
        if not nprobe:
            return search.topk(self.rows(), query, k, self.metric).select("id", "score", "text", "ts", "rank")
        indexed, centres, fresh = self._indexed()
        cells = ivf.nearest_cells(centres, query, nprobe)
        own = indexed.where(F.col("cell").isin(cells)).select("id", "vector").unionByName(fresh)
        hits = search.settled(search.topk(self._live(own), query, k, self.metric).select("id", "score", "rank"))
        return search.attach(hits, self.all_rows().select("id", "text", "ts")).select("id", "score", "text", "ts", "rank")

    def batch_search(self, queries: DataFrame, k: int = 5, nprobe: int = 0) -> DataFrame:
        """Rows (query_id, rank, id, score) for a table of queries (id, vector): exact, or with nprobe by the index."""
        if not nprobe:
            return search.batch_topk(self.rows(), queries, k, self.metric)
        indexed, centres, fresh = self._indexed()
        found = ivf.batch_probe(self._live(indexed), centres, queries, k, nprobe, self.metric)
        return search.ranked(found.drop("rank").unionByName(search.batch_topk(self._live(fresh), queries, k, self.metric).drop("rank")), k)

    def build_index(self, lists: int = 0) -> None:
        """Inverted lists over the live rows, published as a commit of its own; lists of 0: the square root of the rows.

        Centres are fitted on a bounded sample (ivf.SAMPLE rows), every row is indexed. Cells are a
        partition column, so a search reads the files of its cells only; large cells are split over
        several files.
        """
        rows = self.rows().select("id", "vector")
        centres = ivf.fit(rows, lists or max(1, int(self.count_live() ** 0.5)))
        tag = uuid.uuid4().hex
        cells = ivf.assign(rows, centres).hint("rebalance", "cell")
        cells.write.partitionBy("cell").parquet(self.files.at("index", tag))
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(self.files.at("index", tag + "-centres"))
        self._commit(index={"dir": tag, "upto": self.state["next_id"], "elements": self.count_live()})

    def _indexed(self) -> tuple[DataFrame, np.ndarray, DataFrame]:
        """The index's rows (id, vector, cell), its centres, and the rows put since."""
        at = self.state.get("index")
        if not at:
            raise ValueError("the collection has no index; see build_index")
        read = lambda d: self.spark.read.parquet(self.files.at("index", d))
        centres = np.array([r["centre"] for r in read(at["dir"] + "-centres").orderBy("cell").collect()])
        return read(at["dir"]), centres, self.all_rows().where(F.col("id") >= at["upto"]).select("id", "vector")

    def _live(self, rows: DataFrame) -> DataFrame:
        return search.live(rows, self.tombstones()) if self.state["tombstones"] else rows

    @_counts_failures("search_ts")
    def search_ts_range(self, query: Sequence[float], k: int = 5, start: str = "", end: str = "", candidate_k: int = 0, mode: str = "post") -> DataFrame:
        self._check(query)
        self.counters["search_ts"] += 1
        return search.topk_in_window(self.rows(), query, k, start, end, candidate_k, mode, self.metric).select("id", "score", "text", "ts", "rank")

    def _check(self, vector: Sequence[float]) -> None:
        if len(vector) != self.dim:
            raise ValueError(f"a vector of {self.dim} components is needed, not {len(vector)}")

    # ------------------------------------------------------------ writes

    @_counts_failures("put")
    def put(self, vector: Sequence[float], text: str = "", ts: str = "") -> int:
        self._check(vector)
        self.counters["put"] += 1
        check_quota(self.count_live(), 1, self.max_vectors)
        new = self.state["next_id"]
        self._commit(self.spark.createDataFrame([(new, [float(x) for x in vector], text, ts)], SCHEMA), 1)
        return new

    @_counts_failures("put_batch")
    def put_batch(self, rows: DataFrame, order: str | None = None, dead: DataFrame | None = None, mark: tuple[str, int] | None = None) -> range:
        """Append rows (vector, and text and ts if there; external, if there, names them) in one commit; returns their ids.

        Ids follow `order`, or the rows' order in the DataFrame. dead: ids to delete in the same
        commit. mark: a stream's name and batch number, which the commit remembers.
        """
        self.counters["put_batch"] += 1
        return self._append(rows, order, dead, mark)

    def _append(self, rows: DataFrame, order: str | None = None, dead: DataFrame | None = None, mark: tuple[str, int] | None = None) -> range:
        """Rows are staged with their place (partition and row of it); the partitions' sizes make places dense ids."""
        for c in ("text", "ts"):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(""))
        named = [F.col("external")] if "external" in rows.columns else []
        rows = (rows.orderBy(order) if order else rows).select(F.col("vector").cast("array<float>").alias("vector"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("ts", F.lit("")).alias("ts"), *named)
        staging = ("_staging", uuid.uuid4().hex)
        rows.withColumn("__place", F.monotonically_increasing_id()).write.parquet(self.files.at(*staging))
        try:
            rows = self.spark.read.parquet(self.files.at(*staging)).withColumn("__part", F.shiftright("__place", 33))
            wrong = F.col("vector").isNull() | (F.size("vector") != self.dim)
            parts = rows.groupBy("__part").agg(F.count("*").alias("n"), F.count(F.when(wrong, 1)).alias("bad"))
            n, bad = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
            if bad:
                raise ValueError(f"{bad} vectors don't have {self.dim} components")
            first, n_dead = self.state["next_id"], self._known(dead) if dead is not None else 0
            if not n and not n_dead:
                return range(first, first)
            check_quota(self.count_live() - n_dead, n, self.max_vectors)
            before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per partition
            starts = parts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
            at = F.col("__place") - F.shiftleft(F.col("__part"), 33)
            rows = rows.join(starts, "__part").withColumn("id", F.lit(first).cast("bigint") + F.col("__start") + at)
            self._commit(rows.select("id", "vector", "text", "ts") if n else None, n, dead.select("id").distinct() if n_dead else None, n_dead, rows.select("external", "id") if named and n else None, mark)
        finally:
            self.files.delete(*staging)
        return range(first, first + n)

    def _known(self, ids: DataFrame) -> int:
        """How many different ids; KeyError for those that aren't live."""
        ids = ids.select(F.col("id").cast("bigint").alias("id")).distinct()
        n = ids.count()
        good = ids.where((F.col("id") >= 0) & (F.col("id") < self.state["next_id"]))
        if search.live(good, self.tombstones()).count() != n:
            raise KeyError("unknown or deleted id")
        return n

    @_counts_failures("delete")
    def delete(self, ids: int | DataFrame) -> int:
        """Tombstone an id or a table of ids; deleting twice is an error."""
        d = self.spark.createDataFrame([(ids,)], "id bigint") if isinstance(ids, int) else ids
        n = self._known(d)
        self.counters["delete"] += n
        if n:
            self._commit(dead=d.distinct(), n_dead=n)
        return n

    @_counts_failures("update")
    def update(self, id: int, vector: Sequence[float], text: str = "", ts: str = "") -> int:
        """Replace a row: tombstone and append in one commit; returns the new id."""
        self._check(vector)
        old = self.spark.createDataFrame([(id,)], "id bigint")
        self._known(old)
        self.counters["update"] += 1
        new = self.state["next_id"]
        self._commit(self.spark.createDataFrame([(new, [float(x) for x in vector], text, ts)], SCHEMA), 1, old, 1)
        return new

    def delete_match(self, query: Sequence[float], match_rank: int = 0, search_top_k: int = 10) -> int:
        """Delete the hit of 0-based rank match_rank among the first search_top_k (1 to 50)."""
        hit = search.hit_at(self.search(query, max(1, min(50, search_top_k))), match_rank).select("id").first()
        if hit is None:
            raise KeyError(f"no hit of rank {match_rank}")
        self.delete(hit["id"])
        return hit["id"]

    def forget(self, query: Sequence[float], k: int = 1) -> int:
        """Delete all of a query's k nearest."""
        ids = [(r["id"],) for r in self.search(query, k).select("id").collect()]  # k rows
        return self.delete(self.spark.createDataFrame(ids, "id bigint")) if ids else 0

    def merge(self) -> int:
        """Rewrite the row files of many small commits as one set of files in one commit; ids and reads stay the same.

        Returns how many directories became fewer. Older readers still find the old files.
        """
        s, out = self.state["rows"], []
        for scale in dict.fromkeys(r["scale"] for r in s):
            dirs = [r["dir"] for r in s if r["scale"] == scale]
            if len(dirs) > 1:
                tag = uuid.uuid4().hex
                self.spark.read.parquet(*(self.files.at("data", d) for d in dirs)).hint("rebalance").write.parquet(self.files.at("data", tag))
                dirs = [tag]
            out += [{"dir": d, "scale": scale} for d in dirs]
        if len(out) < len(s):
            n = self.state["commit"] + 1
            self._publish(n, self.state | {"rows": out})
            self.state = self.state | {"rows": out, "commit": n}
        return len(s) - len(out)

    def sync(self) -> None:
        """Commits are durable when published; only the counter moves."""
        self.counters["sync"] += 1

    def compact(self, target: str) -> Collection:
        """Live rows into a new, empty collection, ids made dense again in id order."""
        to = Collection(self.spark, target, self.dim, self.metric, self.dtype)
        if to.count():
            raise ValueError(f"{target} isn't empty")
        to.put_batch(self.rows(), "id")
        self.counters["compact"] += 1
        return to

    # ------------------------------------------------------------ administration

    def stats(self) -> DataFrame:
        """One row of gauges and counters."""
        s = self.state
        row = {"dim": s["dim"], "metric": s["metric"], "dtype": s["dtype"], "count": self.count(), "count_live": self.count_live(), "tombstones": s["deleted"], "commits": s["commit"], "files": len(s["rows"]), "staged": self.staged(), "index_elements": s.get("index", {}).get("elements", 0)} | {f"n_{k}": v for k, v in self.counters.items()}
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'bigint'}" for k, v in row.items()))

    def staged(self) -> int:
        """Staged directories that no commit names."""
        named = {r["dir"] for r in self.state["rows"]} | set(self.state["tombstones"])
        return sum(d not in named for kind in ("data", "tombstones") for d in self.files.list(kind))

    def doctor(self) -> DataFrame:
        """Rows (check, ok, detail)."""
        s, out = self.state, []
        n = self.all_rows().agg(F.count("*").alias("n"), F.countDistinct("id").alias("u"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.when(F.size("vector") != self.dim, 1)).alias("bad")).first()
        out.append(("format", s["format_version"] == FORMAT, f"version {s['format_version']}"))
        out.append(("files", all(self.files.exists("data", r["dir"]) for r in s["rows"]), f"{len(s['rows'])} data directories"))
        out.append(("rows", n["n"] == s["next_id"], f"{n['n']} rows, {s['next_id']} expected"))
        out.append(("ids", n["n"] == n["u"] and (not n["n"] or (n["lo"], n["hi"]) == (0, s["next_id"] - 1)), f"{n['u']} different"))
        out.append(("dim", n["bad"] == 0, f"{n['bad']} vectors of another length"))
        out.append(("tombstones", self.tombstones().distinct().count() == s["deleted"], f"{s['deleted']} expected"))
        out.append(("staged", True, f"{self.staged()} unpublished directories"))
        return self.spark.createDataFrame(out, "check string, ok boolean, detail string")

    def snapshot(self, target: str) -> dict:
        """Copy the files that the latest commit names, and a manifest. An index isn't copied."""
        to = Files(self.spark, target)
        if to.list():
            raise ValueError(f"{target} isn't empty")
        util, conf = self.spark._jvm.org.apache.hadoop.fs.FileUtil, self.spark._jsc.hadoopConfiguration()
        for kind, dirs in (("data", [r["dir"] for r in self.state["rows"]]), ("tombstones", self.state["tombstones"]), ("external", self.state.get("external", []))):
            for d in dirs:
                util.copy(self.files.fs, self.files.Path(self.files.at(kind, d)), to.fs, to.Path(to.at(kind, d)), False, conf)
        to.publish(json.dumps({k: v for k, v in self.state.items() if k not in ("commit", "index")}), "_commits", "0.json")
        info = {"format": "collection-snapshot", "format_version": FORMAT, "dim": self.dim, "count": self.count(), "count_live": self.count_live()}
        to.publish(json.dumps(info), "snapshot.json")
        return info

    @classmethod
    def restore(cls, spark: SparkSession, snapshot: str, target: str, force: bool = False) -> Collection:
        """A collection from a snapshot; a target that isn't empty needs force."""
        at, to = Files(spark, snapshot), Files(spark, target)
        if not at.exists("snapshot.json") or json.loads(at.read("snapshot.json"))["format"] != "collection-snapshot":
            raise ValueError(f"{snapshot} is no snapshot")
        if to.list() and not force:
            raise ValueError(f"{target} isn't empty")
        copy = Files(spark, f"{target.rstrip('/')}.restoring-{uuid.uuid4().hex}")
        cls(spark, snapshot).snapshot(copy.root)
        cls(spark, copy.root)  # readable: only now may the target go
        to.delete()
        if not to.fs.rename(to.Path(copy.root), to.Path(target)):
            raise OSError(f"{copy.root} could not be renamed to {target}")
        return cls(spark, target)

    @staticmethod
    def upgrade(spark: SparkSession, path: str, apply: bool = False) -> list[str]:
        """What an older manifest lacks; with apply, a commit that has it."""
        files = Files(spark, path)
        n = max(int(f[:-5]) for f in files.list("_commits") if f[:-5].isdigit())
        s = json.loads(files.read("_commits", f"{n}.json"))
        if s.get("format_version", 0) > FORMAT:
            raise ValueError("the collection is newer than this library")
        changes = [f"{k}: {v!r}" for k, v in (("dtype", "float32"), ("scale", 1.0), ("tombstones", []), ("deleted", 0)) if k not in s]
        if s.get("format_version", 0) < FORMAT:
            changes.append(f"format_version: {s.get('format_version', 0)} -> {FORMAT}")
        if apply and changes:
            files.publish(json.dumps({"dtype": "float32", "scale": 1.0, "tombstones": [], "deleted": 0} | s | {"format_version": FORMAT}), "_commits", f"{n + 1}.json")
        return changes


class Catalog:
    """Collections by namespace under one root."""

    def __init__(self, spark: SparkSession, root: str, max_namespaces: int = 0, max_vectors: int = 0, **options):
        self.spark, self.root, self.most, self.max_vectors, self.options = spark, root, max_namespaces, max_vectors, options
        self.files = Files(spark, root)
        self.open_: dict[str, Collection] = {}

    def names(self) -> list[str]:
        return [n for n in self.files.list() if not n.startswith(("_", "."))]

    def open(self, namespace: str, **options) -> Collection:
        from lodevec.functions.text import valid_namespace

        if valid_namespace(namespace) not in self.open_:
            if namespace not in self.names():
                check_quota(len(self.names()), 1, self.most, "namespaces")
            self.open_[namespace] = Collection(self.spark, self.files.at(namespace), max_vectors=self.max_vectors, **(self.options | options))
        return self.open_[namespace]

    def stats(self) -> DataFrame:
        """A row for each open namespace."""
        rows = [(n, c.count(), c.count_live(), c.dim) for n, c in sorted(self.open_.items())]
        return self.spark.createDataFrame(rows, "ns string, count bigint, count_live bigint, dim int")

    def close_all(self) -> None:
        self.open_.clear()


class ExternalIds:
    """A persisted map from a caller's ids to row ids, part of the collection's commits."""

    def __init__(self, collection: Collection):
        self.c = collection

    def table(self) -> DataFrame:
        """Rows (external, id) of live rows; the latest id of each external one."""
        dirs = self.c.state.get("external", [])
        if not dirs:
            return self.c.spark.createDataFrame([], "external string, id bigint")
        t = self.c.spark.read.parquet(*(self.c.files.at("external", d) for d in dirs))
        return search.live(t.groupBy("external").agg(F.max("id").alias("id")), self.c.tombstones())

    def upsert(self, rows: DataFrame) -> int:
        """rows (external, vector, text, ts): known ids are replaced, others appended, in one commit; returns the number of rows."""
        rows = rows.dropDuplicates(["external"])
        dead = self.table().join(rows.select("external"), "external", "left_semi").select("id")
        return len(self.c.put_batch(rows, "external", dead=dead))

    def hits(self, hits: DataFrame) -> DataFrame:
        """hits with external."""
        return hits.join(self.table(), "id", "left")


SPAN = 1 << 20


def compacted(rows: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    """Live rows with new_id, dense from 0 in id order; for a collection in one table.

    Ids are dense, so spans of SPAN ids bound what a task ranks; a row's new id is its rank in its
    span and the live rows of the spans before, a table of a row per span.
    """
    d = search.live(rows, tombstones, key).withColumn("__span", F.floor(F.col(key) / SPAN))
    before = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy("__span").agg(F.count("*").alias("n")).select("__span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    ranked = d.withColumn("__row", F.row_number().over(Window.partitionBy("__span").orderBy(key)))
    return ranked.join(counts, "__span").withColumn("new_id", F.col("__row") - 1 + F.col("__before")).drop("__span", "__row", "__before")
