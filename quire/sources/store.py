"""The stored index: tables in a folder, partitioned by repo, replaced whole or by document."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..scratch import cleaned, cut, read_small

#: Buckets of a table at least, and bytes of a bucket above which the next whole write makes more of them.
BUCKETS, BUCKET_BYTES = 64, 256 << 20
#: The tables of a repo, and the column whose hash deals out their rows.
TABLES = {
    "sections": "doc_path",
    "postings": "term",
    "term_counts": "term",
    "level_counts": "term",
    "corpus_stats": None,
    "glossary": "term",
    "boilerplate": "line",
    "duplicates": "id",
    "related": "source",
    "links": "source_doc",
    "tree": "id",
    "tags": "tag",
    "embeddings": "content_hash",
    "canary": None,
    "roots": None,
}
#: The document of a row, in tables that are amended by document.
_OF_ID = "regexp_extract(id, '(?s)^.*?::(.*)::', 1)"
DOCUMENTS = {"postings": _OF_ID, "tags": _OF_ID, "links": "source_doc"}
#: Amendments of a table, and documents that have changed by them, until it is written whole again.
MOST_AMENDED, MOST_CHANGED = 8, 100_000
#: Parts in which a large table is moved to its buckets, so that what is shuffled at once is a part of it.
PARTS = 8
#: How rows lie within a bucket, where that is not by key alone.
ORDERS = {"postings": ("term", "level")}


def bucket_of(key, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_of(spark: SparkSession, keys: list[str], buckets: int = BUCKETS) -> set[str]:
    """The buckets of some values of a key. The engine's hash is worked out here where the library for it is there."""
    try:
        import xxhash
    except ImportError:
        rows = spark.createDataFrame([(k,) for k in keys], "k string").select(bucket_of("k", buckets).alias("b")).distinct().collect()
        return {str(r["b"]) for r in rows}
    signed = (int.from_bytes(xxhash.xxh64_digest(k.encode(), seed=42), "big", signed=True) for k in keys)
    return {str(h % buckets) for h in signed}


class Store:
    """Tables of an index under one folder.

    Rows of a table and a repo lie in buckets, by a hash of the table's key, so an update rewrites only the buckets that
    hold changed documents, and a search reads only those of its terms. How many buckets there are follows the size of a table,
    whenever it is written whole, and stands in its pointer; a large bucket is written by several tasks. A write goes to a new version folder. A small
    pointer file, which says for each bucket the version that counts, is replaced last, in one step: readers see the
    rows of before or those of after, whenever a writer fails. What a swap leaves behind is deleted by the next one, so
    readers that have begun can end."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _folder(self, name: str, repo: str) -> str:
        return f"{self.at(name)}/{_escaped(repo)}"

    def _open(self, path: str):
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(context._jsc.hadoopConfiguration()), where

    def _pointer_at(self, name: str, repo: str) -> str:
        return f"{self.path}/_pointers/{name}/{_escaped(repo)}.json"

    def _get(self, path: str, otherwise):
        said = read_small(self.spark, path)
        return otherwise if said is None else json.loads(said)

    def _put(self, path: str, value) -> None:
        """Replaces a small file in one step."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, fresh = self._open(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(fresh, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(fresh), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)

    def _pointer(self, name: str, repo: str) -> dict:
        """repo, buckets (number: versions, the first one whole and others that amend it), of (how many there can be), bytes (when it
        was last written whole), amended (how often since then), changed (the folder of documents changed since then) and left (folders to delete)."""
        return {"repo": repo, "buckets": {}, "left": [], "of": BUCKETS, "bytes": 0, "amended": 0, "changed": None} | self._get(self._pointer_at(name, repo), {})

    def _swap(self, name: str, repo: str, buckets: dict[str, list[str]], more: dict | None = None) -> None:
        """From now on these versions count; folders that the last swap left are deleted."""
        old = self._pointer(name, repo)
        new = old | (more or {})
        gone = [f"{version}/bucket={b}" for b, versions in old["buckets"].items() for version in versions if version not in buckets.get(b, [])]
        gone += [old["changed"]] if old["changed"] and old["changed"] != new["changed"] else []
        self._put(self._pointer_at(name, repo), new | {"buckets": buckets, "left": gone})
        for folder in old["left"]:
            self._remove(f"{self._folder(name, repo)}/{folder}")

    def _pointers(self, name: str, repo: str | None) -> list[dict]:
        if repo:
            return [self._pointer(name, repo)]
        fs, where = self._open(f"{self.path}/_pointers/{name}")
        if not fs.exists(where):
            return []
        files = [f.getPath().getName() for f in fs.listStatus(where)]
        return [self._pointer(name, _unescaped(f.removesuffix(".json"))) for f in files if f.endswith(".json") and not f.startswith(".")]

    def exists(self, name: str) -> bool:
        if name in TABLES:
            return any(p["buckets"] for p in self._pointers(name, None))
        fs, where = self._open(self.at(name))
        return fs.exists(where) and any(not x.getPath().getName().startswith(("_", ".")) for x in fs.listStatus(where))

    def load(self, name: str, repo: str | None = None, keys: list[str] | None = None, schema=None) -> DataFrame | None:
        """A table, or None where there is none. With values of the table's key, only their buckets are read; a known schema saves looking it up."""
        pointers = self._pointers(name, repo)
        wanted = {} if keys is None else {of: buckets_of(self.spark, keys, of) for of in {p["of"] for p in pointers}}
        paths = [f"{self._folder(name, p['repo'])}/{version}/bucket={b}" for p in pointers for b, versions in p["buckets"].items() if keys is None or b in wanted[p["of"]] for version in versions]
        if not paths and keys is not None:
            whole = self.load(name, repo)
            return None if whole is None else whole.limit(0)
        if schema is not None and name in DOCUMENTS:
            schema = StructType([*schema.fields, StructField("amended", IntegerType())])
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return self._live(reader.parquet(*paths), name, pointers) if paths else None

    def _live(self, rows: DataFrame, name: str, pointers: list[dict]) -> DataFrame:
        """Rows without those of documents that a later amendment has replaced."""
        for p in pointers:
            if p["changed"]:
                # MOST_CHANGED documents at most
                changed = F.broadcast(self.spark.read.schema("doc_path string, since int").parquet(f"{self._folder(name, p['repo'])}/{p['changed']}"))
                dead = (F.expr(DOCUMENTS[name]) == F.col("doc_path")) & (F.col("amended") < F.col("since")) & (F.col("repo") == p["repo"])
                rows = rows.join(changed, dead, "left_anti")
        return rows.drop("amended")

    def load_side(self, name: str, repo: str, schema: str) -> DataFrame:
        """A table that can be made anew from sections: empty where there is none or its files cannot be read."""
        try:
            table = self.load(name, repo)
            if table is not None:
                table.limit(1).collect()
                return table
        except Exception:  # damaged or lost files
            pass
        return self.spark.createDataFrame([], schema)

    def add_savings(self, tokens: int) -> int:
        """Adds to the running total of tokens saved; the new total. A total that cannot be read starts again."""
        total = self.savings() + max(0, tokens)
        self._put(f"{self.path}/_savings.json", {"total_tokens_saved": total})
        return total

    def savings(self) -> int:
        try:
            return int(self._get(f"{self.path}/_savings.json", {}).get("total_tokens_saved", 0))
        except (ValueError, AttributeError):
            return 0

    def weights(self) -> dict[str, float]:
        """The tuned weight of vectors in the search of each repo that has one."""
        try:
            return {str(k): float(v) for k, v in self._get(f"{self.path}/_weights.json", {}).items()}
        except (ValueError, AttributeError, TypeError):
            return {}

    def keep_weights(self, weights: dict[str, float]) -> None:
        self._put(f"{self.path}/_weights.json", self.weights() | weights)

    def _write(self, rows: DataFrame, name: str, repo: str, of: int, amended: int = 0) -> tuple[dict[str, str], int]:
        """Writes a repo's rows as a new version; the buckets it has, and its bytes. Rows with a column ``part`` are moved part by part."""
        rows = rows.withColumn("amended", F.lit(amended)) if name in DOCUMENTS else rows
        version = uuid.uuid4().hex
        path, key = f"{self._folder(name, repo)}/{version}", TABLES[name]
        dealt = rows.withColumns({"repo": F.lit(repo), "bucket": bucket_of(key, of) if key else F.lit(0)})
        # large buckets are split among tasks; rows are sorted, so that a reader skips what lies outside the keys it looks for
        order = ORDERS.get(name, (key,) if key else ())
        each = [dealt.filter(F.col("part") == k).drop("part") for k in range(PARTS)] if "part" in rows.columns else [dealt]
        with cleaned(self.spark):
            for x in each:
                x.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path, mode="append", compression="zstd")
        fs, where = self._open(path)
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return {n.removeprefix("bucket="): version for n in names if n.startswith("bucket=")}, fs.getContentSummary(where).getLength()

    def _whole(self, rows: DataFrame, name: str, repo: str) -> None:
        """Replaces a repo's part of a table, with as many buckets as its last size asks for."""
        old = self._pointer(name, repo)
        of = BUCKETS
        while of * BUCKET_BYTES < old["bytes"]:
            of *= 2
        buckets, size = self._write(rows, name, repo, of)
        self._swap(name, repo, {b: [v] for b, v in buckets.items()}, {"of": of, "bytes": size, "amended": 0, "changed": None})

    def amend(self, name: str, repo: str, rows: DataFrame, docs: DataFrame | None = None) -> None:
        """Adds rows to a repo's part of a table, as a version of its own in the buckets that they fall in. The rows that documents of ``docs``
        (doc_path) had before are dead from then on. After ``MOST_AMENDED`` times, or ``MOST_CHANGED`` documents, the table is written whole."""
        p = self._pointer(name, repo)
        now, changed = p["amended"] + 1, p["changed"]
        buckets, _ = self._write(rows, name, repo, p["of"], now)
        many = now >= MOST_AMENDED
        if docs is not None:
            since = docs.select("doc_path", F.lit(now).alias("since"))
            if changed:
                since = since.unionByName(self.spark.read.schema(since.schema).parquet(f"{self._folder(name, repo)}/{changed}")).groupBy("doc_path").agg(F.max("since").alias("since"))
            changed = f"changed-{uuid.uuid4().hex}"
            since.coalesce(1).write.parquet(f"{self._folder(name, repo)}/{changed}")  # compared with MOST_CHANGED at every step
            many = many or self.spark.read.parquet(f"{self._folder(name, repo)}/{changed}").count() > MOST_CHANGED
        every = {b: [*p["buckets"].get(b, []), *([buckets[b]] if b in buckets else [])] for b in {**p["buckets"], **buckets}}
        self._swap(name, repo, every, {"amended": now, "changed": changed})
        if many:
            whole = self.load(name, repo)
            if name == "term_counts":
                whole = whole.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
            elif name == "level_counts":
                whole = whole.groupBy("term", "level").agg(F.sum("n").alias("n")).filter("n <> 0")
            self._whole(whole.drop("bucket", "repo"), name, repo)

    def _state(self, repo: str) -> dict:
        return {"sections": self._pointer("sections", repo)["buckets"]}

    def mark_derived(self, repo: str) -> None:
        """Notes that the derived tables stand for the sections there are."""
        self._put(f"{self.path}/_derived/{_escaped(repo)}.json", self._state(repo))

    def is_derived(self, repo: str) -> bool:
        return self._get(f"{self.path}/_derived/{_escaped(repo)}.json", {}) == self._state(repo)

    def save(self, sections: DataFrame) -> None:
        """Replaces the sections of the repos in ``sections``."""
        for r in sections.select("repo").distinct().collect():  # the repos of one call
            self._whole(sections.filter(F.col("repo") == r[0]), "sections", r[0])

    def save_incremental(self, repo: str, changed: DataFrame, gone: DataFrame) -> None:
        """Replaces documents: ``changed`` has new rows of sections, ``gone`` the doc_path of documents that are no more.

        Only buckets with such documents are read and written again."""
        out = gone.select("doc_path").unionByName(changed.select("doc_path")).distinct()
        pointer = self._pointer("sections", repo)
        now, of = pointer["buckets"], pointer["of"]
        touched = [str(r[0]) for r in out.select(bucket_of("doc_path", of)).distinct().collect()]  # as many as there are buckets
        paths = [f"{self._folder('sections', repo)}/{version}/bucket={b}" for b in touched for version in now.get(b, [])]
        fresh = changed
        if paths:
            old = self.spark.read.parquet(*paths)
            fresh = changed.unionByName(old.join(out, "doc_path", "left_anti"), allowMissingColumns=True)
        new, _ = self._write(fresh, "sections", repo, of)
        self._swap("sections", repo, {b: v for b, v in now.items() if b not in touched} | {b: [v] for b, v in new.items()})

    def save_side(self, name: str, repo: str, rows: DataFrame) -> None:
        """Replaces a repo's part of a table that is derived from sections."""
        self._whole(rows, name, repo)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds to a ledger: calls, ranking events, replays."""
        rows.write.mode("append").parquet(self.at(name))

    def append_json(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").json(self.at(name))

    def read_json(self, name: str, schema: str, limit: int | None = None) -> DataFrame:
        """A JSON ledger; lines that are not JSON are passed over."""
        rows = self.spark.read.schema(schema).option("mode", "DROPMALFORMED").json(self.at(name))
        return rows.orderBy(F.desc("ts")).limit(limit) if limit else rows

    def trim(self, name: str, keep: int, order: str = "ts") -> None:
        """Keeps the newest rows of a ledger."""
        kept = cut(self.spark.read.parquet(self.at(name)).orderBy(F.desc(order)).limit(keep), "trim")
        kept.write.mode("overwrite").parquet(self.at(name))

    def _remove(self, path: str) -> None:
        fs, where = self._open(path)
        fs.delete(where, True)

    def delete(self, repo: str, names: tuple[str, ...] = tuple(TABLES)) -> None:
        """Forgets a repo: pointers first, then files."""
        for name in names:
            self._remove(self._pointer_at(name, repo))
        for name in names:
            self._remove(self._folder(name, repo))

    def repos(self) -> DataFrame:
        sections = self.load("sections")
        if sections is None:
            return self.spark.createDataFrame([], "repo string, doc_count bigint, section_count bigint")
        return sections.groupBy("repo").agg(F.countDistinct("doc_path").alias("doc_count"), F.count("*").alias("section_count"))

    def resolve(self, name: str) -> str:
        """A full repo name; a bare one is looked up, and is local where none or several end with it."""
        if "/" in name or not self.exists("sections"):
            return name if "/" in name else f"local/{name}"
        hits = [r[0] for r in self.load("sections").select("repo").distinct().filter(F.endswith("repo", F.lit("/" + name))).limit(2).collect()]
        return hits[0] if len(hits) == 1 else f"local/{name}"

    def define_group(self, group: str, repos: list[str]) -> None:
        """Names a group of repos; an empty list deletes it."""
        old = self.spark.read.parquet(self.at("repo_groups")) if self.exists("repo_groups") else None
        rows = self.spark.createDataFrame([(group, r, i) for i, r in enumerate(repos)], "group_name string, repo string, ord int")
        if old is not None:
            rows = cut(old.filter(F.col("group_name") != group).unionByName(rows), "groups")
        rows.write.mode("overwrite").parquet(self.at("repo_groups"))

    def groups(self) -> DataFrame:
        return self.spark.read.parquet(self.at("repo_groups"))


def _escaped(value: str) -> str:
    return "".join(c if c not in '"#%\'*/:=?\\\x7f{[]^' and ord(c) >= 32 else f"%{ord(c):02X}" for c in value)


def _unescaped(name: str) -> str:
    import re

    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), name)
