"""Byte-level BPE by corpus-level merge replay.

1. Texts are split into words, block by block (``BLOCK_BYTES`` of text). A word that is a token of the vocabulary has
   its id at once; any other is a place in the block's list of words. Coded texts and lists are packed and written out.
2. The lists are dealt by a hash of the word, so each distinct word of the whole corpus comes to one task, which merges it
   once. All bytes of a task's words stand in one flat list; an inverted index from the rank of a token pair to the
   positions where that pair stands holds all merges that are due. Ranks are taken in order, each is applied at all its
   positions at once, and only the pairs beside a merged position are looked at anew. A merge that opens a pair of
   lower rank is rare; such a word is merged by itself.
3. The ids go back to the blocks, where they fill the places in the coded texts. Decoding reads the ids.

So a word's merges are worked out once, however many documents hold it, and no table that grows with the corpus is
broadcast: the rank file is, and its size is that of the vocabulary. The number of word buckets follows the size of the texts.

Defined cases: a null or empty text has no ids; bytes that are not UTF-8 are read as U+FFFD; repeated rows repeat
their results; an empty table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded_batches, cut, table

#: Characters of text that share a list of words, bytes of words that are merged at a time, and tokens of a packed row.
BLOCK_BYTES, REPLAY_BYTES, ROW_TOKENS = 32_000_000, 2_000_000, 200_000
#: Places in lists of words that a task holds before it writes their ids, and pairs that are looked up at a time.
HELD_WORDS, LOOKED_UP = 4_000_000, 250_000
#: Bytes of text for each bucket of words, and the fewest and most buckets.
BUCKET_BYTES, BUCKETS = 32_000_000, (32, 65_536)
#: Merged words that a task keeps while it goes from bucket to bucket.
KEPT_WORDS = 300_000
_SHIFT = 24


class Merges:
    """The ranks of a vocabulary, and the replay of its merges."""

    def __init__(self, rank_file: bytes, pattern: str):
        import numpy as np
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.size = max(self.ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.find = regex.compile(pattern).findall
        self.length = np.array([len(t) for t in self.bytes_of] or [0], np.int32)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # the rank that two tokens side by side merge to, for all pairs there are
        self.pairs = {self.ranks[t[:i]] << _SHIFT | self.ranks[t[i:]]: r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        order = sorted(self.pairs)
        self.pair_keys = np.array([*order, 1 << 62], np.int64)
        self.pair_ranks = np.array([*(self.pairs[k] for k in order), -1], np.int32)
        self.words: dict[str, int] = {}
        for token, rank in self.ranks.items():
            try:
                self.words[token.decode()] = rank
            except UnicodeDecodeError:
                continue  # part of a character: no word of a text

    def pair(self, a, b):
        """The ranks of tokens side by side (arrays), -1 where they do not merge."""
        import numpy as np

        keys = a.astype(np.int64) << _SHIFT | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def alone(self, word: bytes) -> list[int]:
        """Merges one word by itself: always the lowest rank, the leftmost of equals."""
        tokens = [int(self.single[b]) for b in word]
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get(tokens[i] << _SHIFT | tokens[i + 1], -1)) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if tokens[i] < 0 or j >= n or self.pairs.get(tokens[i] << _SHIFT | tokens[j], -1) != rank:
                continue
            k = after[j]
            tokens[i], tokens[j], after[i] = rank, -1, k
            if k < n:
                before[k] = i
                if (r := self.pairs.get(rank << _SHIFT | tokens[k], -1)) >= 0:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := self.pairs.get(tokens[h] << _SHIFT | rank, -1)) >= 0:
                heapq.heappush(heap, (r, h))
        return [t for t in tokens if t >= 0]

    def due(self, tokens):
        """Places of tokens that merge with the next one, in the order of the rank they merge to, and these ranks."""
        import numpy as np

        places, ranks = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for lo in range(0, len(tokens) - 1, LOOKED_UP):  # by parts: what a look-up needs is several times what it gives
            part = tokens[lo : lo + LOOKED_UP + 1]
            at = np.flatnonzero((part[:-1] >= 0) & (part[1:] >= 0)).astype(np.int32)
            rank = self.pair(part[at], part[at + 1])
            places.append(at[rank >= 0] + np.int32(lo))
            ranks.append(rank[rank >= 0])
        at, rank = np.concatenate(places), np.concatenate(ranks)
        del places, ranks
        order = np.argsort(rank, kind="stable").astype(np.int32)
        return at[order], rank[order]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers, all words merged together, in rank order."""
        import numpy as np

        counts, ids = self.replayed(words)
        data, ends = ids.tobytes(), (4 * np.cumsum(counts, dtype=np.int64)).tolist()
        return [data[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]

    def replayed(self, words: list[bytes]):
        """The same as two arrays: how many ids each word has, and all ids."""
        import numpy as np

        if not words:
            return np.zeros(0, "<u4"), np.zeros(0, "<u4")
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes + 1) - 1  # a mark that no pair reaches across stands behind each word
        raw = np.frombuffer(b"\0".join([*words, b""]), np.uint8)
        tokens = self.single[raw]
        tokens[ends] = -1
        n = len(tokens)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        at, rank = self.due(tokens)
        bounds = np.searchsorted(rank, np.arange(self.size + 1))
        del rank, raw
        due: dict[int, list] = {}
        lower: list = []
        for r in range(self.size):
            parts = due.pop(r, None)
            lo, hi = bounds[r], bounds[r + 1]
            if parts is None:
                if lo == hi:
                    continue
                p = at[lo:hi]
            else:
                p = np.unique(np.concatenate([*parts, at[lo:hi]]))
            # the bytes at a place do not change: two tokens there that are as long as the merged one are the pair
            a, j = tokens[p], after[p]
            b = tokens[j]
            p = p[(a >= 0) & (b >= 0) & (self.length[a] + self.length[b] == self.length[r])]
            if not len(p):
                continue
            j = after[p]
            if len(p) > 1 and (j[:-1] == p[1:]).any():  # places that share a token: from the left, every other one
                linked = np.concatenate([[False], j[:-1] == p[1:]])
                place = np.arange(len(p))
                first = np.maximum.accumulate(np.where(linked, 0, place))
                p = p[(place - first) % 2 == 0]
                j = after[p]
            k = after[j]
            tokens[p], tokens[j] = r, -2
            after[p], before[k] = k, p
            h = before[p]
            left, right = p[(h >= 0) & (tokens[h] >= 0)], p[tokens[k] >= 0]
            near = np.concatenate([before[left], right])
            if not len(near):
                continue
            found = self.pair(tokens[near], tokens[after[near]])
            near, found = near[found >= 0], found[found >= 0]
            if not len(near):
                continue
            if (found < r).any():
                lower.append(near[found < r])
                near, found = near[found > r], found[found > r]
            order = np.argsort(found, kind="stable")
            near, found = near[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            if len(found):
                for part, new in zip(np.split(near, cuts), found[np.concatenate([[0], cuts])].tolist(), strict=True):
                    due.setdefault(new, []).append(part)
        alive = np.flatnonzero(tokens >= 0)
        ids = tokens[alive].astype("<u4")
        counts = np.diff(np.searchsorted(alive, ends), prepend=0).astype("<u4")
        if lower:
            own = {w: self.alone(words[w]) for w in np.unique(np.searchsorted(ends, np.concatenate(lower))).tolist()}
            first, parts, upto = np.cumsum(counts, dtype=np.int64) - counts, [], 0
            for w, tokens in own.items():
                parts += [ids[upto : first[w]], np.array(tokens, "<u4")]
                upto, counts[w] = first[w] + counts[w], len(tokens)
            ids = np.concatenate([*parts, ids[upto:]])
        return counts, ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        new = sorted(set().union(*split).difference(self.words))
        ids = dict(zip(new, self.replay([w.encode() for w in new]), strict=True))
        return [b"".join(ids[w] if w in ids else self.words[w].to_bytes(4, "little") for w in words) for words in split]

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Known(dict):
    """Codes of words: a token's id, or for any other word ``size`` and its place in the order they came."""

    def __init__(self, merges: Merges):
        super().__init__(merges.words)
        self.own = len(self)
        self.shift = merges.size - self.own

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self) + self.shift
        return code

    def new(self) -> list[str]:
        return list(self)[self.own :]


_KEPT: dict[int, Merges] = {}


def _merges(spec) -> Merges:
    """One for each worker and vocabulary."""
    rank_file, pattern = spec.value
    key = hash((rank_file, pattern))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Merges(rank_file, pattern)
    return _KEPT[key]


def vocabulary(spark: SparkSession, rank_path: str, pattern: str):
    with open(rank_path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


#: The buckets of a block's common codes and of its documents, behind all buckets of words.
_COMMON, _DOCS = 2**31 - 2, 2**31 - 1
#: Common codes have 16 bits; this one says that the code stands apart.
_RARE = 0xFFFF


def _pack(*arrays) -> bytes:
    """Arrays of numbers, or bytes, as one compressed string. Numbers go byte plane by byte plane: the high ones are nearly all alike."""
    import numpy as np
    import zstandard

    parts = [x if isinstance(x, bytes) else x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(x) for x in parts], "<u8").tobytes() + b"".join(parts))


def _unpack(data: bytes, *kinds) -> list:
    """What was packed: arrays of the kinds given, bytes for None."""
    import numpy as np
    import zstandard

    raw, n = zstandard.ZstdDecompressor().decompress(data), len(kinds)
    ends = (8 * n + np.cumsum(np.frombuffer(raw[: 8 * n], "<u8"))).tolist()
    out = []
    for kind, lo, hi in zip(kinds, [8 * n, *ends[:-1]], ends, strict=True):
        part = raw[lo:hi]
        out.append(part if kind is None else np.frombuffer(np.frombuffer(part, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.tobytes(), kind))
    return out


def _places(first, counts):
    """The places of runs: those that start at first and are as long as counts say, one after the other."""
    import numpy as np

    upto = np.cumsum(counts, dtype=np.int64)
    return np.repeat(first - (upto - counts), counts) + np.arange(upto[-1] if len(upto) else 0)


def _coder(vocab, buckets: int):
    """For each block: rows of its words, bucket by bucket; the commonest codes; rows of documents, with their ids and codes."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        merges = _merges(vocab)
        size = merges.size
        block, total, known, held, none = TaskContext.get().partitionId() << 32, 0, Known(merges), [], None

        def row(bucket, ids, data):
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), ids, pa.array([data], pa.binary())], ["block", "bucket", "ids", "data"])

        def closed():
            # places follow the buckets and the words in them, so they need not be written beside the words
            new = known.new()
            known.clear()  # done with, and large
            bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in new), np.int32, len(new))
            order = np.array(sorted(range(len(new)), key=new.__getitem__), np.int32)  # code points are in the order of their bytes
            order = order[np.argsort(bucket[order], kind="stable")]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                mine = [new[i].encode() for i in order[cuts[b] : cuts[b + 1]].tolist()]
                yield row(b, none, _pack(np.array([len(w) for w in mine], "<u4"), b"".join(mine)))
            code = np.arange(size + len(new), dtype=np.int32)
            code[size + order] = size + np.arange(len(new), dtype=np.int32)
            del new, bucket, order
            uses = sum(np.bincount(codes, minlength=len(code)) for _, _, codes in held)
            common = np.argsort(-uses, kind="stable")[:_RARE]
            yield row(_COMMON, none, _pack(code[common].astype("<u4")))
            brief = np.full(len(code), _RARE, "<u2")
            brief[common] = np.arange(len(common))
            for ids, counts, codes in held:
                short = brief[codes]
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield row(_DOCS, listed, _pack(counts, short, code[codes[short == _RARE]].astype("<u4")))

        for batch in batches:
            ids, first, coded, tokens = batch["doc_id"], 0, [], 0
            none = pa.nulls(1, pa.list_(ids.type))
            for n, raw in enumerate(batch["raw"], 1):
                text = (raw.as_py() or b"").decode("utf-8", "replace")
                coded.append(np.fromiter(map(known.__getitem__, merges.find(text)), np.int32))
                total += len(text)
                tokens += len(coded[-1])
                if tokens >= ROW_TOKENS or total >= BLOCK_BYTES or n == batch.num_rows:
                    held.append((ids.take(pa.array(np.arange(first, n))), np.array([len(c) for c in coded], "<u4"), np.concatenate(coded)))
                    first, coded, tokens = n, [], 0
                if total >= BLOCK_BYTES:
                    yield from closed()
                    block, total, known, held = block + 1, 0, Known(merges), []
        if held:
            yield from closed()

    return run


def _replayer(vocab):
    """From rows of words to rows of their ids. Rows come bucket by bucket; a word is merged once, with all others of the task that are new."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        merges = _merges(vocab)
        place: dict[bytes, int] = {}  # of each word in counts and first
        counts, ids = np.zeros(0, "<u4"), np.zeros(0, "<u4")
        new, held, now, fresh, volume = [], [], None, 0, 0

        def merged():
            nonlocal counts, ids, fresh, volume
            more, own = merges.replayed(new)
            counts, ids = np.concatenate([counts, more]), np.concatenate([ids, own])
            first = np.cumsum(counts, dtype=np.int64) - counts
            for block, bucket, words in held:
                data = _pack(counts[words], ids[_places(first[words], counts[words])])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], ["block", "bucket", "data"])
            new.clear()
            held.clear()
            fresh = volume = 0

        for batch in batches:
            for block, bucket, data in zip(batch["block"].to_pylist(), batch["bucket"].to_pylist(), batch["data"], strict=True):
                if bucket != now and len(place) > KEPT_WORDS:  # no other bucket has these words
                    yield from merged()
                    place.clear()
                    counts, ids = counts[:0], ids[:0]
                now = bucket
                lengths, raw = _unpack(data.as_py(), "<u4", None)
                words, lo = np.zeros(len(lengths), np.int32), 0
                for i, n in enumerate(lengths.tolist()):
                    w = raw[lo : lo + n]
                    lo += n
                    at = place.get(w, -1)
                    if at < 0:
                        at = place[w] = len(place)
                        new.append(w)
                        fresh += n + 1
                    words[i] = at
                held.append((block, bucket, words))
                volume += len(words)
                if fresh >= REPLAY_BYTES or volume >= HELD_WORDS:
                    yield from merged()
        yield from merged()

    return run


def _filler(vocab, decoded: bool):
    """Ids of coded texts. Of a block, the rows of words come first, in the order of their places, then the common codes."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        merges = _merges(vocab)
        single = np.arange(merges.size, dtype="<u4")
        names = ["doc_id", "ids", "n_tokens", "decoded"][: 4 if decoded else 3]
        now, lists, common, lengths, first, flat = None, [], None, None, None, None
        for batch in batches:
            for i, (block, bucket) in enumerate(zip(batch["block"].to_pylist(), batch["bucket"].to_pylist(), strict=True)):
                data = batch["data"][i].as_py()
                if block != now:
                    now, lists = block, []
                if bucket < _COMMON:
                    lists.append(_unpack(data, "<u4", "<u4"))
                    continue
                if bucket == _COMMON:
                    common = _unpack(data, "<u4")[0].astype(np.int64)
                    lengths = np.concatenate([np.ones(merges.size, np.int64), *(x[0].astype(np.int64) for x in lists)])
                    flat = np.concatenate([single, *(x[1] for x in lists)])
                    first, lists = np.cumsum(lengths) - lengths, []
                    continue
                counts, short, rare = _unpack(data, "<u4", "<u2", "<u4")
                codes = common[np.minimum(short, len(common) - 1)] if len(common) else short.astype(np.int64)
                codes[short == _RARE] = rare
                n = lengths[codes]
                upto = np.concatenate([[0], np.cumsum(n)])
                raw = flat[_places(first[codes], n)].tobytes()
                bounds = upto[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
                out = [raw[4 * lo : 4 * hi] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [batch["ids"][i].values, pa.array(out, pa.binary()), pa.array(np.diff(bounds), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(map(merges.decode, out), pa.binary())] if decoded else []), names)

    return run


def _encoded(docs: DataFrame, vocab, decoded: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    size = raw.agg(F.sum(F.length("raw"))).first()[0] or 0
    buckets = min(max(size // BUCKET_BYTES, BUCKETS[0]), BUCKETS[1])
    coded = cut(raw.mapInArrow(_coder(vocab, buckets), f"block bigint, bucket int, ids array<{kind}>, data binary"), "coded")
    lists = coded.filter(F.col("bucket") < _COMMON).select("block", "bucket", "data").repartition("bucket").sortWithinPartitions("bucket", "block")
    merged = lists.mapInArrow(_replayer(vocab), "block bigint, bucket int, data binary")
    both = coded.filter(F.col("bucket") >= _COMMON).unionByName(merged, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(_filler(vocab, decoded), f"doc_id {kind}, ids binary, n_tokens bigint" + (", decoded binary" if decoded else ""))


def encode(docs: DataFrame, vocab) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens."""
    return _encoded(docs, vocab, False)


def round_trip(docs: DataFrame, vocab) -> DataFrame:
    """doc_id, ids, n_tokens and decoded: what ``decode(encode(docs))`` gives, ids and decoding in one pass."""
    return _encoded(docs, vocab, True)


def decode(encoded: DataFrame, vocab) -> DataFrame:
    """doc_id, ids, n_tokens and decoded (binary)."""
    bounded_batches(encoded.sparkSession)

    def run(batches):
        import pyarrow as pa

        merges = _merges(vocab)
        for batch in batches:
            decoded = [merges.decode(x) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens bigint, decoded binary")


def multi_vocabulary(spark: SparkSession):
    import public_tokenizers

    return vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def digests(docs: DataFrame, vocab) -> DataFrame:
    out = round_trip(docs, vocab)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), multi_vocabulary(spark))
