"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Documents are sets of five-word shingles (words are runs without white space, ASCII letters lower-cased; a text of
fewer words is one shingle). Documents with the same words form a class, which stands for its copies from then on. A
signature of ``TREES`` x 8 one-byte min-hash labels puts a class into as many prefix tries. A subtree under a node at the
shortest depth goes to one task (a large one as pairs of blocks), where its signatures are sorted and walked from whole
labels upwards: at each depth the runs of equal prefixes give the pairs that met there first. Prefixes are shortened for a
band of similarity until a pair in it is found with the chance wanted, so near copies are harvested from long prefixes
and only bands near the threshold go on to short ones; the threshold's own band always goes to the depth that this
chance needs, whatever else a table holds. A pair's band comes from its sketch, less ``SLACK`` standard deviations.
A pair that meets in several tries is harvested once, where its prefix is longest. Last, candidates are verified on the exact
shingle sets; a sketch estimate as far under the threshold rules pairs out.

Defined cases: null and empty texts, and texts of white space, have no words: they are one class, copies of each other,
and link with nothing else; repeated rows are copies of each other; a null doc_id comes after all others, and rows whose
id is that of their group are kept, so several rows without an id may be; an empty table gives no rows; columns beyond
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets
from .components import components
from .scratch import bounded_batches, cut, settled, table

WORDS, JACCARD, RECALL = 5, 0.8, 0.998
TREES, DEEP = 16, 8
SLACK = 4.5
_ODD = 0x9E3779B97F4A7C15


def found_chance(s, depth: int):
    return 1 - (1 - s**depth) ** TREES


def depth_for(jaccard: float, recall: float) -> int:
    """Labels of the longest prefix that finds a pair of this similarity with the chance wanted."""
    return next((d for d in range(DEEP, 1, -1) if found_chance(jaccard, d) >= recall), 1)


def _deviation(s: float) -> float:
    return (s * (1 - s) / (TREES * DEEP)) ** 0.5


def band_depths(jaccard: float, recall: float) -> list[int]:
    """For each number of equal labels of two sketches: the depth at which the band of such pairs is done."""
    shares = [k / (TREES * DEEP) for k in range(TREES * DEEP + 1)]
    return [depth_for(max(jaccard, s - SLACK * _deviation(s)), recall) for s in shares]


def _space():
    import numpy as np

    is_space = np.zeros(256, bool)
    is_space[[9, 10, 11, 12, 13, 32]] = True
    return is_space


def shingles(texts: list[bytes], n: int = WORDS):
    """(word hashes, first word of each text), (shingle hashes, first shingle of each text), as unsigned 64-bit arrays and bounds."""
    import numpy as np

    raw = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _space()[raw]
    inside = ~space
    begin = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    if not len(begin):
        none = np.zeros(len(texts) + 1, np.int64)
        return (np.zeros(0, np.uint64), none), (np.zeros(0, np.uint64), none)
    at = np.flatnonzero(inside)
    bounds = np.searchsorted(at, begin)
    place = np.arange(len(at)) - np.repeat(bounds, np.diff(np.append(bounds, len(at))))
    powers = np.cumprod(np.full(int(place.max()) + 1, _ODD, np.uint64), dtype=np.uint64)
    words = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * powers[place], bounds)
    words ^= words >> np.uint64(32)
    words *= np.uint64(0xD6E8FEB86659FD93)
    words ^= words >> np.uint64(32)
    first = np.concatenate([[0], np.searchsorted(begin, ends)])
    count = np.diff(first)
    made = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    s_first = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(len(texts)), made)
    start = first[owner] + np.arange(s_first[-1]) - s_first[owner]
    out = np.zeros(len(start), np.uint64)
    short = np.minimum(count, n)[owner]
    for k in range(n):
        have = short > k
        w = words[np.minimum(start + k, len(words) - 1)]
        out = np.where(have, (out ^ w) * np.uint64(_ODD), out)
        out ^= out >> np.uint64(31)
    return (words, first), (out, s_first)


def signatures(hashes, bounds):
    """A row of TREES * DEEP one-byte labels for each text that has shingles."""
    import numpy as np

    rng = np.random.default_rng(5)
    a = rng.integers(1, 2**31, TREES * DEEP).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, TREES * DEEP).astype(np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), len(a)), np.uint8)
    if len(starts):
        v = np.empty_like(x)
        for f in range(len(a)):
            np.multiply(x ^ b[f], a[f], out=v)
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            low = np.minimum.reduceat(v, starts)
            out[:, f] = ((low ^ (low >> np.uint32(9))) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def _blocks(batches, limit=400_000):
    """Parts of batches with about ``limit`` bytes of text, and their texts."""
    for batch in batches:
        raw = batch["raw"]
        first, total, texts = 0, 0, []
        for i in range(batch.num_rows):
            texts.append(raw[i].as_py() or b"")
            total += len(texts[-1])
            if total >= limit:
                yield batch.slice(first, i + 1 - first), texts
                first, total, texts = i + 1, 0, []
        if texts:
            yield batch.slice(first), texts


def _class_key(words) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _signed(batches):
    import numpy as np
    import pyarrow as pa

    for rows, texts in _blocks(batches):
        (words, first), (hashes, bounds) = shingles(texts)
        some = np.diff(bounds) > 0
        sig = iter(signatures(hashes, bounds))
        keys = [_class_key(words[lo:hi]) for lo, hi in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(keys, pa.binary()), pa.array([next(sig).tobytes() if ok else None for ok in some], pa.binary())], ["doc_id", "c_key", "sketch"])


def _sets(batches):
    import numpy as np
    import pyarrow as pa

    for _, texts in _blocks(batches):
        (words, first), (hashes, bounds) = shingles(texts)
        keys = [_class_key(words[lo:hi]) for lo, hi in zip(first[:-1], first[1:], strict=True)]
        data = [np.unique(hashes[lo:hi]).tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["c_key", "data"])


def overlaps(sets: list, a, b):
    """Sizes of the intersections of pairs of sorted hash arrays."""
    import numpy as np

    if len(a) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    sizes = [len(s) for s in sets]
    values, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    use = shared[inverse]
    owner, inverse = owner[use], column[inverse[use]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = max(64, 8_000_000 // max(1, len(sets)))
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    for lo in range(0, int(shared.sum()), width):
        p, q = np.searchsorted(inverse, [lo, lo + width])
        part = np.zeros((len(sets), min(width, int(shared.sum()) - lo)), np.float32)
        part[owner[p:q], inverse[p:q] - lo] = 1
        out += part @ part.T
    return out[a, b].astype(np.int64)


def _verifier(jaccard: float):
    def verify(data, t, a, b):
        import numpy as np

        sets = [np.frombuffer(d, np.uint64) for d in data]
        size = np.array([len(s) for s in sets], np.int64)
        both = overlaps(sets, a, b)
        return both >= jaccard * (size[a] + size[b] - both) - 1e-9

    return verify


def _walker(shortest: int):
    """The pairs of subtrees, each at the depth where its prefixes part: from whole labels up to the shortest prefix."""

    def walk(bounds, side, s, t):
        import numpy as np

        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        own = np.ascontiguousarray(s.reshape(len(s), TREES, DEEP)[np.arange(len(s)), t])
        label = own.view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((label, group))
        label, group, side = label[order], group[order], side[order]
        for depth in range(DEEP, shortest - 1, -1):
            prefix = label >> np.uint64(8 * (DEEP - depth))
            edges = np.flatnonzero((group[1:] != group[:-1]) | (prefix[1:] != prefix[:-1])) + 1
            for a, b in buckets.pairs_within(np.concatenate([[0], edges, [len(label)]]), side):
                if depth < DEEP:
                    longer = label >> np.uint64(8 * (DEEP - depth - 1))
                    new = longer[a] != longer[b]
                    a, b = a[new], b[new]
                if len(a):
                    yield order[a], order[b], depth

    return walk


def _keeper(jaccard: float, recall: float):
    """Of the pairs that met at a depth: those that may be similar enough, whose band is open there, and that no other tree has under a longer prefix."""
    least, done = jaccard - SLACK * _deviation(jaccard), band_depths(jaccard, recall)

    def keep(s, t, a, b, depth):
        import numpy as np

        same = (s[a] == s[b]).reshape(len(a), TREES, DEEP)
        equal = same.sum((1, 2))
        mask = (equal >= least * TREES * DEEP) & (depth >= np.array(done)[equal])
        at = np.flatnonzero(mask)
        lengths = np.cumprod(same[at], 2).sum(2)
        mask[at] = (lengths.max(1) == depth) & (lengths.argmax(1) == t[a[at]])
        return mask

    return keep


def ngram_join(docs: DataFrame, jaccard: float = JACCARD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (smallest doc_id with the same words), n_links (other rows at or above the threshold), component_id, kept."""
    bounded_batches(docs.sparkSession)
    base = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = cut(base.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(_signed, f"doc_id {kind}, c_key binary, sketch binary"), "signed")
    classes = signed.groupBy("c_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("weight"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    sketches = classes.filter("sketch IS NOT NULL").select("id", "sketch")
    depth = depth_for(jaccard, recall)
    prefixes = F.array(*[F.xxhash64(F.substring("sketch", DEEP * t + 1, depth)) for t in range(TREES)])
    dealt = buckets.tasks(sketches.select("id", prefixes.alias("keys")))
    found = cut(buckets.units(dealt, sketches, _keeper(jaccard, recall), _walker(depth)), "units")
    wanted = found.select("id").distinct().join(classes.select("id", "class_id", "c_key", "weight"), "id")
    wanted = cut(wanted, "wanted")
    ids = wanted.select("class_id").distinct()
    texts = base.join(ids, F.col("doc_id").eqNullSafe(F.col("class_id")), "left_semi")  # a class of rows without ids has a null id
    sets = texts.select(F.col("text").cast("binary").alias("raw")).mapInArrow(_sets, "c_key binary, data binary")
    payload = wanted.select("id", "c_key", "weight").join(sets, "c_key").dropDuplicates(["id"]).select("id", "weight", "data")
    linked = cut(buckets.links(found, cut(payload, "sets"), _verifier(jaccard)), "links")
    counts = linked.groupBy("id").agg(F.sum("n").alias("others"))
    groups = components(linked.select("id", "root"), "id", "root")
    named = classes.select("id", "c_key", "class_id", "weight").join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    lowest = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("class_id").alias("lowest"))
    named = named.join(lowest, "component", "left").select("c_key", "class_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("lowest", "class_id").alias("component_id"))
    out = signed.select("doc_id", "c_key").join(named, "c_key", "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: ngram_join(table(spark, sf_dir, "documents")), "ngrams")
