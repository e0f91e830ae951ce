"""Links among rows that share a bucket, without rows for all pairs.

A row has a key for each of several tables; rows with one key in one table share a bucket. Large buckets are dealt out
as pairs of blocks, so no task gets a whole bucket and a row is repeated once for each block beside its own. In a task,
pairs are index arrays: a sketch rules out most, and those left go on as units (the rows of a task that still have a
partner, and the pairs among them). In a second step the units meet the rows' full payload, and pairs are verified.
What comes out is a row for each row of a unit: its number of links and the smallest row it hangs together with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, SMALL, PAIRS = 512, 48, 100_000


def tasks(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """From id and keys (array<long>): task, t, side, id for every row that shares a bucket."""
    each = keys.select("id", F.posexplode("keys").alias("t", "k"))
    counts = each.groupBy("t", "k").agg(F.count("*").alias("c")).filter("c > 1").select("t", "k", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    shared = each.join(counts, ["t", "k"])
    dealt = shared.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, F.lit(0)).when(F.col("own") == low, F.lit(1)).otherwise(F.lit(2))
    return dealt.select(F.xxhash64("t", "k", low, high).alias("task"), "t", side.alias("side"), "id")


def _whole_groups(batches: Iterator, key: str) -> Iterator:
    """Tables that hold whole runs of equal keys."""
    import numpy as np
    import pyarrow as pa

    kept: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch[key].to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(x[1:] != x[:-1])
        if kept and x[0] != kept[-1][key][kept[-1].num_rows - 1].as_py():
            yield pa.Table.from_batches(kept).combine_chunks()
            kept = []
        if len(ends):
            at = int(ends[-1]) + 1
            yield pa.Table.from_batches([*kept, batch.slice(0, at)]).combine_chunks()
            kept = [batch.slice(at)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _bounds(x):
    import numpy as np

    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])


def pairs_within(bounds, side) -> Iterator:
    """Index arrays of the pairs within groups, about PAIRS at a time. Sides 1 and 2 pair with each other only."""
    import numpy as np

    sizes = np.diff(bounds)
    for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        i, j = np.triu_indices(n, 1)
        starts = bounds[:-1][sizes == n]
        step = max(1, PAIRS // len(i))
        for at in range(0, len(starts), step):
            base = starts[at : at + step, None]
            a, b = (base + i).ravel(), (base + j).ravel()
            ok = (side[a] == 0) | (side[a] != side[b])
            yield a[ok], b[ok]
    for start, n in zip(bounds[:-1][sizes > SMALL], sizes[sizes > SMALL], strict=True):
        rows = np.arange(start, start + n)
        if side[start] == 0:
            step = max(1, PAIRS // n)
            for at in range(0, n, step):
                a, b = np.meshgrid(rows[at : at + step], rows, indexing="ij")
                up = a < b
                yield a[up], b[up]
        else:
            left, right = rows[side[rows] == 1], rows[side[rows] == 2]
            if not len(left) or not len(right):
                continue
            step = max(1, PAIRS // len(right))
            for at in range(0, len(left), step):
                a, b = np.meshgrid(left[at : at + step], right, indexing="ij")
                yield a.ravel(), b.ravel()


def all_pairs(bounds, side, s, t) -> Iterator:
    """Index arrays of all pairs of rows in one task, a part at a time."""
    yield from pairs_within(bounds, side)


def units(dealt: DataFrame, sketches: DataFrame, keep: Callable, walk: Callable = all_pairs) -> DataFrame:
    """unit, t, id, slot, pairs: rows of ``dealt`` that ``keep(sketch, t, a, b, ...)`` pairs with another. sketches: id, sketch (binary, all of one length).

    walk(bounds, side, sketch, t) gives the pairs (index arrays a and b, and what else keep is to know of them), each once.
    pairs: on slot 0, the unit's pairs of slots as unsigned 16-bit integers."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for tab in _whole_groups(batches, "task"):
            task, t = tab["task"].to_numpy(), tab["t"].to_numpy()
            sketch = tab["sketch"].combine_chunks()
            sketch = sketch.chunk(0) if isinstance(sketch, pa.ChunkedArray) else sketch
            width = len(sketch[0].as_py())
            s = np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(-1, width)
            bounds = _bounds(task)
            found = [(a[m], b[m]) for a, b, *more in walk(bounds, tab["side"].to_numpy(), s, t) for m in [keep(s, t, a, b, *more)] if m.any()]
            if not found:
                continue
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            rows = np.unique(np.concatenate([a, b]))
            group = np.searchsorted(bounds, rows, "right") - 1
            first = np.searchsorted(group, group)
            slot = (np.arange(len(rows)) - first).astype(np.int32)
            slot_of = np.zeros(len(task), np.uint16)
            slot_of[rows] = slot
            pair_group = np.searchsorted(bounds, a, "right") - 1
            order = np.argsort(pair_group, kind="stable")
            packed = np.stack([slot_of[a], slot_of[b]], 1)[order]
            edges = _bounds(pair_group[order])
            out = [None] * len(rows)
            for at, (lo, hi) in zip(np.flatnonzero(slot == 0), zip(edges[:-1], edges[1:], strict=True), strict=True):
                out[at] = packed[lo:hi].tobytes()
            ids = tab["id"].take(pa.array(rows)).combine_chunks()
            whole = pa.table([pa.array(task[rows]), pa.array(t[rows], pa.int32()), ids, pa.array(slot), pa.array(out, pa.binary())], ["unit", "t", "id", "slot", "pairs"])
            yield from whole.to_batches(max_chunksize=5000)

    joined = dealt.join(sketches, "id").repartition("task").sortWithinPartitions("task", "id")
    return joined.select("task", "t", "side", "id", "sketch").mapInArrow(run, "unit bigint, t int, id bigint, slot int, pairs binary")


def local_roots(n: int, a, b):
    """The smallest index that each of n rows hangs together with through the pairs."""
    import numpy as np

    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def links(found: DataFrame, payload: DataFrame, verify: Callable) -> DataFrame:
    """id, root, n: for each row of a unit, the weight of its links there and the smallest id it hangs together with there.

    payload: id, weight (long), data (binary). verify(list of data, t, a, b) gives a mask of the pairs (index arrays)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for tab in _whole_groups(batches, "unit"):
            unit, t, ids, weight = (tab[c].to_numpy() for c in ("unit", "t", "id", "weight"))
            bounds, data, pairs = _bounds(unit), tab["data"], tab["pairs"]
            heads = pairs.to_pylist()
            out_id, out_root, out_n = [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                p = np.frombuffer(heads[lo], "<u2").reshape(-1, 2).astype(np.int64)
                a, b = p[:, 0], p[:, 1]
                own = data.slice(lo, hi - lo).to_pylist()
                if len(a) and max(int(a.max()), int(b.max())) >= len(own):
                    raise ValueError("a unit came without all of its rows")
                ok = verify(own, int(t[lo]), a, b)
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                n = np.zeros(hi - lo, np.int64)
                w = weight[lo:hi]
                np.add.at(n, a, w[b])
                np.add.at(n, b, w[a])
                order = np.argsort(ids[lo:hi], kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(hi - lo)
                root = order[local_roots(hi - lo, place[a], place[b])[place]]
                has = np.flatnonzero(n)
                out_id.append(ids[lo:hi][has])
                out_root.append(ids[lo:hi][root[has]])
                out_n.append(n[has])
            if out_id:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_id, out_root, out_n)], ["id", "root", "n"])

    met = found.join(payload, "id").repartition("unit").sortWithinPartitions("unit", "slot")
    return met.select("unit", "t", "id", "slot", "pairs", "weight", "data").mapInArrow(run, "id bigint, root bigint, n bigint")
