"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosines.

Vectors are normalised; a cosine of c is a distance of sqrt(2 - 2c). A hash is a random projection, shifted and cut
into cells of ``WIDTH`` times the threshold's distance. Each table joins several hashes. Their number follows the
number of vectors (unrelated vectors, at right angles, should rarely share a bucket), and the number of tables follows
from the recall wanted for pairs right at the threshold; pairs above it are found more often. A pair in one bucket is
first held against 128 signs of random projections (five standard deviations of room), then its cosine is worked out in
double precision. Rows whose unit vectors are the same form a class, which stands for its copies from then on and counts as often as it has
rows, so copies of one vector cost nothing beyond the first. A pair that shares buckets in several tables counts in the first of them only. Vectors of one length
are compared with each other; the length is part of the bucket.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of
different lengths do not link; repeated rows with one vec_id and vector are links of each other but share their result; an
empty table gives no rows; columns beyond vec_id and the embedding are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets
from .components import components
from .scratch import bounded_batches, cut, settled, table

COSINE, WIDTH, RECALL, SEED = 0.9, 4.0, 0.97, 11
MOST_TABLES = 200


def collision(ratio: float) -> float:
    """Chance that two points at a distance share a cell; ratio: the cell's width over the distance."""
    tail = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int, float]:
    """Hashes a table, tables, width of a cell."""
    near = math.sqrt(2 - 2 * cosine)
    width = WIDTH * near
    p1, p2 = collision(WIDTH), collision(width / math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(p2)))
    while True:
        tables = math.ceil(math.log(1 - recall) / math.log(1 - p1**k))
        if tables <= MOST_TABLES:
            return k, tables, width
        k -= 1


def _maker(dim: int, k: int, tables: int, width: float):
    """A function from normalised vectors to bucket keys, and the planes of the sketch."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    planes, shift, signs = rng.standard_normal((dim, k * tables)), rng.uniform(0, width, k * tables), rng.standard_normal((dim, 128))
    odd = rng.integers(1, 2**62, k).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    start = np.uint64((dim * 0x9E3779B97F4A7C15) % 2**64)

    def keys(x):
        cells = np.floor((x @ planes + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, k)
        h = np.full((len(x), tables), start, np.uint64)
        for i in range(k):
            h = (h ^ cells[:, :, i]) * odd[i]
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    return keys, signs


def near_vectors(rows: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    bounded_batches(rows.sparkSession)
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    marked = cut(rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("id", F.monotonically_increasing_id()), "vectors")
    usable = marked.filter("good")
    k, tables, width = plan(usable.count(), cosine, recall)

    def by_length(column):
        """Rows of each length, and their vectors as a matrix of unit vectors."""
        import numpy as np

        sizes = column.value_lengths().to_numpy()
        first = np.cumsum(sizes) - sizes
        flat = column.flatten().to_numpy().astype(np.float64)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            x = flat[first[at][:, None] + np.arange(dim)]
            x = x / np.abs(x).max(1, keepdims=True)
            yield at, x / np.sqrt((x * x).sum(1, keepdims=True))

    def hashed(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        makers = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                for at, x in by_length(part["v"]):
                    dim = x.shape[1]
                    if dim not in makers:
                        makers[dim] = _maker(dim, k, tables, width)
                    keys, signs = makers[dim]
                    bits = np.packbits(x @ signs > 0, axis=1)
                    flat = keys(x).ravel()
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, tables), pa.int32()), pa.array(flat))
                    data = [r.tobytes() for r in x + 0.0]  # no negative zeros
                    digests = pa.array([hashlib.blake2b(d, digest_size=16).digest() for d in data], pa.binary())
                    yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(at)), digests, listed, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(data, pa.binary())], ["id", "same", "keys", "sketch", "data"])

    every = cut(usable.select("id", "v").mapInArrow(hashed, "id bigint, same binary, keys array<bigint>, sketch binary, data binary"), "hashed")
    classes = cut(every.groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "classes")
    items = cut(every.join(classes.select("id", "weight"), "id"), "items")
    far = math.acos(cosine) / math.pi
    most = 128 * far + 5 * math.sqrt(128 * far * (1 - far))

    def keep(s, t, a, b):
        import numpy as np

        return np.bitwise_count(s[a] ^ s[b]).sum(1) <= most

    makers: dict = {}

    def verify(data, t, a, b):
        import numpy as np

        sizes = np.array([len(d) for d in data]) // 8
        if (sizes != sizes[0]).any():  # two lengths whose keys are equal by chance
            ok = np.zeros(len(a), bool)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                mine = np.flatnonzero((sizes[a] == size) & (sizes[b] == size))
                ok[mine] = verify([data[i] for i in rows], t, np.searchsorted(rows, a[mine]), np.searchsorted(rows, b[mine]))
            return ok
        dim = int(sizes[0])
        x = np.frombuffer(b"".join(data), np.float64).reshape(-1, dim)
        if dim not in makers:
            makers[dim] = _maker(dim, k, tables, width)[0]
        cosines = np.einsum("ij,ij->i", x[a], x[b]) if len(a) < 2000 else (x @ x.T)[a, b]
        edge = np.flatnonzero(np.abs(cosines - cosine) < 1e-9)  # these are worked out in one way, whatever the unit's size
        cosines[edge] = [math.fsum(x[i] * x[j]) for i, j in zip(a[edge], b[edge], strict=True)]
        ok = cosines >= cosine
        at = np.flatnonzero(ok)
        h = makers[dim](x) if len(at) else None
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            ok[part] = (h[a[part]] == h[b[part]]).argmax(1) == t
        return ok

    found = buckets.units(buckets.tasks(items.select("id", "keys")), items.select("id", "sketch"), keep)
    linked = cut(buckets.links(found, items.select("id", "weight", "data"), verify), "links")
    counts = linked.groupBy("id").agg(F.sum("n").alias("others"))
    groups = components(linked.select("id", "root"), "id", "root").withColumnRenamed("node", "id")
    known = classes.join(counts, "id", "left").join(groups, "id", "left").select("same", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = marked.select("vec_id", "id").join(every.select("id", "same"), "id", "left").join(known, "same", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
    named = out.filter("n_links > 0").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = out.join(named, "component", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: near_vectors(table(spark, sf_dir, "embeddings")), "vectors")
