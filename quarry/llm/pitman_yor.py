"""LM scoring with a hierarchical Pitman-Yor model.

Restaurants, from the leaves up: one for each preceding word (the start of a
text is a word of its own, the empty one, which also ends it); their common
parent over words; and below that, as the word restaurant's base measure, a
model of spelling, whose restaurants stand for the classes of four preceding
letters (of the fourth, two bits) and share parents of three, two, one and no
letters.  Every probability backs off along this chain and sums to one over all
words there could be.  A context that was never seen is its parent.

Seating is sampled by Gibbs sweeps: all customers of a dish leave their
restaurant and come back one by one, each to an occupied table or, with the
parent's probability, to a new one, which sends a customer to the parent.  Long
queues are drawn exactly as well, from one new table to the next.  Predictive
probabilities are averaged over the sweeps after ``BURN_IN``.  Within a sweep
the parent's probabilities stand still; the leaves are dealt to buckets by
context, and a bucket uses its own tables as its view of the parent.

What is learnt grows with the corpus: every context has a restaurant, none is
pruned, and counts, tables and words stay distributed.  Bounded are only the
cells of the spelling model (``2 ** 25`` however large the corpus), of which the
driver takes a few merged copies, and the contexts that make up more than one
in ``HOT_SHARE`` of all tokens, whose dishes are dealt to several buckets.

1. Texts are packed into pages; a page's words are coded in the order of their
   hashes, so that every bucket, of words or of contexts, is a range of codes
   and answers need no keys.
2. Words go, spelt, to their bucket, which counts them.
3. A page sends its distinct (context, word) pairs with their counts to the
   context's bucket, by 64 and 56 bits of hashes.  The bucket seats its
   restaurants, answers with counts and tables, and sends each word's tables to
   the word's bucket as customers of the parent restaurant.
4. Word buckets seat those and fit the spelling, sweep by sweep, and answer with
   each word's count and averaged probability.
5. Each page puts both answers together.

Nulls: a null text is empty and has one token, its end; null doc_ids hash as
the empty string; repeated rows are texts of their own.  Without training rows
scores come from the base measure alone.  Empty tables give empty results;
other columns are ignored.  A text is one row in memory, however long.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices

FOLDS, HELD_OUT = 5, 1
#: Bytes of text of a page, of a bucket of contexts, and of a bucket of words.
PAGE, PAGE_ROWS, BUCKET, WORD_BUCKET = 5_000_000, 16_384, 12_000_000, 24_000_000
HOT_SHARE = 20_000
#: Bits of context for each of the preceding letters, the closest first.
BITS = (5, 5, 5, 2)
ORDER = len(BITS)
WIDTH = [sum(BITS[:m]) for m in range(ORDER + 1)]
BURN_IN, SAMPLES = 2, 3
#: Dishes that are seated one after the other rather than side by side.
FEW = 2000
#: Concentrations; discounts are estimated from counts of counts.
CONCENTRATION, LEAF_CONCENTRATION = 1.0, 0.2

_CLASS = np.full(256, 28, dtype=np.int64)  # ASCII punctuation and controls
_CLASS[32] = 0
_CLASS[97:123] = np.arange(1, 27)
_CLASS[48:58] = 27
_CLASS[128:160], _CLASS[160:192], _CLASS[192:] = 29, 30, 31


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, byte by byte of all numbers: high bytes are alike."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [np.int64(len(a)).tobytes(), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    for kind in kinds:
        size, n = np.dtype(kind).itemsize, int(np.frombuffer(raw, np.int64, 1, at)[0])
        planes = np.frombuffer(raw, np.uint8, n * size, at + 8).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 8 + n * size
    return out


def steps(rising: np.ndarray) -> np.ndarray:
    """Differences of a rising array: small numbers, which compress."""
    return np.diff(rising, prepend=rising.dtype.type(0))


def total(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=differences.dtype)


def bucket_of(hashes: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """The range of ``hashes`` (so many bits wide) that each one lies in; rising with the hash."""
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]]) if len(values) else [0]
    for a, z in zip(cuts[:-1], cuts[1:]):
        yield int(values[a]), int(a), int(z)


class Words:
    """Byte strings behind each other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self._spelt: tuple[np.ndarray, ...] | None = None

    @classmethod
    def of(cls, array: pa.Array) -> Words:
        joined = pc.binary_join(pa.array([array.cast(pa.binary()).to_pylist()], pa.list_(pa.binary())), b"")[0].as_py() if len(array) else b""
        sizes = pc.binary_length(array).to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum(sizes)]))

    @classmethod
    def joined(cls, parts: list[Words]) -> Words:
        sizes = np.concatenate([np.diff(p.offsets) for p in parts])
        return cls(np.concatenate([p.data for p in parts]), np.concatenate([[0], np.cumsum(sizes)]))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, i: np.ndarray) -> Words:
        size = np.diff(self.offsets)[i]
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.offsets[:-1][i] - offsets[:-1], size) + np.arange(offsets[-1])
        return Words(self.data[at], offsets)

    def range(self, a: int, z: int) -> Words:
        o = self.offsets[a : z + 1]
        return Words(self.data[o[0] : o[-1]], o - o[0])

    def packed(self) -> list[np.ndarray]:
        return [self.data, np.diff(self.offsets).astype(np.uint32)]

    @classmethod
    def unpacked(cls, data: np.ndarray, sizes: np.ndarray) -> Words:
        return cls(data, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))

    def hashes(self) -> np.ndarray:
        raw = self.data.tobytes()
        o = self.offsets.tolist()
        return np.fromiter((xxhash.xxh64_intdigest(raw[a:z]) for a, z in zip(o, o[1:])), dtype=np.uint64, count=len(o) - 1)

    def letters(self) -> tuple[np.ndarray, ...]:
        """Distinct cells (context << 8 | letter) of spellings with their closing space, the number of each letter's, and where each word's letters begin and how many they are."""
        if self._spelt is None:
            cells, first, size = self._cells()
            self._spelt = (*np.unique(cells, return_inverse=True), first, size)
        return self._spelt

    def _cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.diff(self.offsets) + 1
        first = np.concatenate([[0], np.cumsum(size)])
        n = int(first[-1])
        stream = np.full(n, 32, dtype=np.int64)
        place = np.arange(n) - np.repeat(first[:-1], size)
        stream[place < np.repeat(size - 1, size)] = self.data
        kind, context = _CLASS[stream], np.zeros(n, dtype=np.int64)
        for k in range(1, ORDER + 1):
            context[k:] |= np.where(place[k:] >= k, kind[:-k] & ((1 << BITS[k - 1]) - 1), 0) << WIDTH[k - 1]
        return context << 8 | stream, first[:-1], size


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS == HELD_OUT for i in ids], dtype=bool)


def tokenise(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Distinct words (the empty one is the end), codes of all tokens, tokens of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(split)
    owner = pc.list_parent_indices(split).to_numpy()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    encoded = flat.filter(pa.array(real)).dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    counts = np.bincount(owner[real], minlength=len(texts))
    codes = np.insert(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, np.cumsum(counts), 0)
    return Words.of(pa.concat_arrays([pa.array([""]), encoded.dictionary.cast(pa.string())])), codes, counts + 1


def pages(docs: DataFrame, page_bytes: int = PAGE) -> DataFrame:
    """One row a page: its documents (sizes and fold, ids, the words' codes in order of their hashes) and its lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = TaskContext.get().partitionId() << 32
        for b in slices(batches, PAGE_ROWS):
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            start = 0
            while start < b.num_rows:
                end = max(start + 1, start + int(np.searchsorted(np.cumsum(size[start:]), page_bytes)))
                end = min(end, b.num_rows, start + PAGE_ROWS)
                part = b.slice(start, end - start)
                ids = part.column("doc_id").to_pylist()
                words, codes, tokens = tokenise(part.column("text"))
                hashes = words.hashes()
                order = np.argsort(hashes)
                rank = np.empty(len(order), dtype=np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                words, hashes, codes = words.take(order), hashes[order], rank[codes]
                out = held_out(ids)
                trained = np.bincount(codes[np.repeat(~out, tokens)], minlength=len(order)).astype(np.uint32)
                used = int(trained.sum())
                often = np.flatnonzero(trained > used / (2 * HOT_SHARE))
                hot = [{"h": h, "n": n} for h, n in zip(hashes[often].view(np.int64).tolist(), trained[often].tolist())] if used else []
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([part.schema.field("doc_id")])) as w:
                    w.write_batch(part.select(["doc_id"]))
                columns = {
                    "page": pa.array([page], pa.int64()), "n_bytes": pa.array([int(size[start:end].sum())], pa.int64()), "n_train": pa.array([used], pa.int64()),
                    "codes": pa.array([pack(tokens.astype(np.uint32), out.astype(np.uint8), codes)], pa.binary()), "ids": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                    "lexicon": pa.array([pack(*words.packed(), trained)], pa.binary()), "often": pa.array([hot], pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))),
                }
                yield pa.RecordBatch.from_pydict(columns)
                page, start = page + 1, end

    return docs.select("doc_id", "text").mapInArrow(run, "page bigint, n_bytes bigint, n_train bigint, codes binary, ids binary, lexicon binary, often array<struct<h:bigint,n:bigint>>")


def deal(paged: DataFrame, buckets: int) -> DataFrame:
    """bucket, page, words: a page's words with their counts, by range of the words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            for page, blob in zip(b.column("page").to_pylist(), b.column("lexicon").to_pylist()):
                data, sizes, trained = unpack(blob, np.uint8, np.uint32, np.uint32)
                words = Words.unpacked(data, sizes)
                rows = [(k, page, pack(*words.range(a, z).packed(), trained[a:z])) for k, a, z in runs(bucket_of(words.hashes(), buckets))]
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary())], ["bucket", "page", "words"])

    return paged.select("page", "lexicon").mapInArrow(run, "bucket int, page bigint, words binary")


VOCABULARY = "bucket int, vocabulary binary, known bigint, pages array<bigint>, places array<binary>"


def merge(table: pa.Table) -> pa.Table:
    """A bucket's words in order of their hashes with their counts, and where each page's words are among them."""
    parts = [unpack(e, np.uint8, np.uint32, np.uint32) for e in table.column("words").to_pylist()]
    lexica = [Words.unpacked(data, sizes) for data, sizes, _ in parts]
    hashes = [x.hashes() for x in lexica]
    _, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([p[2] for p in parts]), minlength=len(first)).astype(np.int64)
    cuts = np.cumsum([0] + [len(h) for h in hashes])
    places = [pack(steps(place[a:z].astype(np.uint32))) for a, z in zip(cuts, cuts[1:])]
    words = Words.joined(lexica).take(first)
    return pa.table({
        "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "vocabulary": pa.array([pack(*words.packed(), counts)], pa.binary()),
        "known": pa.array([int((counts > 0).sum())], pa.int64()), "pages": pa.array([table.column("page").to_pylist()], pa.list_(pa.int64())), "places": pa.array([places], pa.list_(pa.binary())),
    })


class Hot:
    """Contexts whose dishes are dealt to several buckets of their own, by range of the dishes' hashes."""

    def __init__(self, found: list[tuple[int, int]], buckets: int) -> None:
        found = sorted((int(np.int64(h).view(np.uint64)), parts) for h, parts in found)
        self.hashes = np.array([h for h, _ in found], dtype=np.uint64)
        self.parts = np.array([p for _, p in found], dtype=np.int64)
        self.first = buckets + np.concatenate([[0], np.cumsum(self.parts)[:-1]]).astype(np.int64) if found else self.parts


def pairs_of(codes: np.ndarray, tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and word of the distinct pairs, in order, and of each token its pair."""
    codes = codes.astype(np.int64)
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    first = np.concatenate([[0], np.cumsum(tokens.astype(np.int64))[:-1]])
    before[first] = codes[first[0] + int(tokens[0]) - 1]  # the word that ends a text
    pairs, place = np.unique(before * size + codes, return_inverse=True)
    return pairs // size, pairs % size, place


def pair_packs(paged: DataFrame, buckets: int, hot: Hot) -> DataFrame:
    """bucket, page, start, hot, pairs: a page's runs of pairs; ``start`` is a run's first pair, ``hot`` the context's hash where it has buckets of its own."""
    shared = paged.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches, 1):
            for page, blob, lexicon in zip(*(b.column(c).to_pylist() for c in ("page", "codes", "lexicon"))):
                tokens, out, codes = unpack(blob, np.uint32, np.uint8, np.uint32)
                data, sizes, _ = unpack(lexicon, np.uint8, np.uint32, np.uint32)
                hashes = Words.unpacked(data, sizes).hashes()
                u, w, place = pairs_of(codes, tokens, len(hashes))
                n = np.bincount(place[np.repeat(out == 0, tokens)], minlength=len(u)).astype(np.uint32)
                del place, codes
                dish = hashes >> np.uint64(8)
                bucket = bucket_of(hashes, buckets)[u]
                for h, parts, first in zip(own.hashes, own.parts, own.first):
                    code = int(np.searchsorted(hashes, h))
                    if code < len(hashes) and hashes[code] == h:
                        a, z = np.searchsorted(u, [code, code + 1])
                        bucket[a:z] = first + bucket_of(dish[w[a:z]], int(parts), 56)
                rows = []
                for k, a, z in runs(bucket):
                    mine, head = np.unique(u[a:z], return_index=True)
                    dishes, which = np.unique(w[a:z], return_inverse=True)
                    sizes = np.diff(np.append(head, z - a)).astype(np.uint32)
                    blob = pack(steps(hashes[mine]), sizes, steps(dish[dishes]), which.astype(np.uint32), n[a:z])
                    rows.append((k, page, a, int(hashes[mine[0]].view(np.int64)) if k >= buckets else None, blob))
                c = list(zip(*rows))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], ["bucket", "page", "start", "hot", "pairs"])

    return paged.select("page", "codes", "lexicon").mapInArrow(run, "bucket int, page bigint, start bigint, hot bigint, pairs binary")


_PAIRS = (np.uint64, np.uint32, np.uint64, np.uint32, np.uint32)
SEATED = "page bigint, start bigint, hot bigint, reply binary, bucket int, customers binary, mass double"


def discount(one: float, two: float) -> float:
    """From counts of counts; where they say nothing, a middling one."""
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.3


def seat_bucket(table: pa.Table, word_buckets: int) -> pa.Table:
    """A bucket's restaurants after Gibbs sweeps: answers to the pages, and the tables of each word by bucket of words.

    An answer has counts and, summed over the samples, tables of each pair and
    tables of each context; ``mass`` is what a hot context's part adds to the
    share of its parent.
    """
    parts = [unpack(e, *_PAIRS) for e in table.column("pairs").to_pylist()]
    hot = table.column("hot").to_pylist()
    us, u_place = np.unique(np.concatenate([total(p[0]) for p in parts]), return_inverse=True)
    ws, w_place = np.unique(np.concatenate([total(p[2]) for p in parts]), return_inverse=True)
    u_cuts, w_cuts = (np.cumsum([0] + [len(p[k]) for p in parts]) for k in (0, 2))
    u = np.repeat(u_place, np.concatenate([p[1] for p in parts]))
    w = np.concatenate([w_place[a:z][p[3]] for p, a, z in zip(parts, w_cuts, w_cuts[1:])])
    cells, place = np.unique(u * len(ws) + w, return_inverse=True)
    n = np.bincount(place, weights=np.concatenate([p[4] for p in parts]), minlength=len(cells)).astype(np.int64)
    cuts = np.cumsum([0] + [len(p[4]) for p in parts])
    del u, w
    sizes = [len(p[4]) for p in parts]
    del parts
    u, w = cells // len(ws), cells % len(ws)
    r = np.random.default_rng(table.column("bucket")[0].as_py())
    share = discount(int((n == 1).sum()), int((n == 2).sum()))
    t = np.minimum(n, 1).astype(np.float64)
    live = np.flatnonzero(n > 1)
    summed = np.zeros(len(cells), dtype=np.int64)
    rooms, samples = np.zeros(len(us)), []
    for k in range(BURN_IN + SAMPLES):
        dishes, mine = np.bincount(w, weights=t, minlength=len(ws)), np.bincount(u, weights=t, minlength=len(us))
        p = (dishes + 0.5) / (dishes.sum() + 0.5 * len(ws))
        t[live] = seat(n[live], p[w[live]], LEAF_CONCENTRATION, share, mine[u[live]] - t[live], r)
        if k >= BURN_IN:
            summed += t.astype(np.int64)
            rooms += np.bincount(u, weights=t, minlength=len(us))
            samples.append(np.bincount(w, weights=t, minlength=len(ws)).astype(np.int64))
    more = (summed - SAMPLES * np.minimum(n, 1)).astype(np.uint32)
    rows: list[tuple] = []
    for k, (page, start) in enumerate(zip(table.column("page").to_pylist(), table.column("start").to_pylist())):
        i = place[cuts[k] : cuts[k + 1]]
        reply = pack(np.array([share]), n[i].astype(np.uint32), more[i], rooms[u_place[u_cuts[k] : u_cuts[k + 1]]].astype(np.uint32))
        rows.append((page, start, hot[k], reply, None, None, None))
    seen = np.flatnonzero(samples[0])
    kept = ws[seen]
    for k, a, z in runs(bucket_of(kept, word_buckets, 56)):
        first = samples[0][seen[a:z]]
        blob = pack(steps(kept[a:z]), first.astype(np.uint32), *((s[seen[a:z]] - first).astype(np.int32) for s in samples[1:]))
        rows.append((None, None, None, None, k, blob, None))
    if hot[0] is not None:
        rows.append((None, None, hot[0], None, None, None, share * float(rooms[0])))
    c = list(zip(*rows))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.float64()]
    return pa.table([pa.array(x, k) for x, k in zip(c, kinds)], names=["page", "start", "hot", "reply", "bucket", "customers", "mass"])


def with_customers(vocabulary: pa.Table, seated: pa.Table) -> pa.Table:
    """A bucket of words with the customers that all contexts send, by sample."""
    (blob,) = vocabulary.column("vocabulary").to_pylist()
    data, sizes, counts = unpack(blob, np.uint8, np.uint32, np.int64)
    keys = Words.unpacked(data, sizes).hashes() >> np.uint64(8)
    sums = np.zeros((SAMPLES, len(keys)), dtype=np.int64)
    for e in seated.column("customers").to_pylist():
        dish, first, *others = unpack(e, np.uint64, np.uint32, *[np.int32] * (SAMPLES - 1))
        at = np.searchsorted(keys, total(dish))
        for k, s in enumerate([first.astype(np.int64), *(first.astype(np.int64) + o for o in others)]):
            sums[k, at] += s
    once = [int((sums[0] == k).sum()) for k in (1, 2)]
    return vocabulary.append_column("queue", pa.array([pack(*sums)], pa.binary())).append_column("once", pa.array([once], pa.list_(pa.int64())))


def _queue_up(n: int, done: int, t: float, p: float, concentration: float, discount: float, others: float, r: random.Random) -> float:
    """Tables after customers ``done + 1`` to ``n`` of one dish.

    Where new tables are rare, the number of customers who join occupied ones
    before the next is drawn at once, from the product of their probabilities;
    otherwise one customer after the other is drawn.
    """
    draw_, lgamma = r.random, math.lgamma
    while done < n:
        fresh, old = (concentration + discount * (others + t)) * p, max(done - discount * t, 1e-12)
        if old < 16 * fresh:
            t += draw_() * (fresh + old) < fresh
            done += 1
            continue
        # log of the chance that m join is lgamma(old + m) - lgamma(old + fresh + m), less its value for none
        bound = math.log(1 - draw_()) + lgamma(old) - lgamma(old + fresh)
        low, high = 0, 1
        while high <= n - done and lgamma(old + high) - lgamma(old + fresh + high) >= bound:
            low, high = high, 2 * high
        high = min(high, n - done + 1)
        while high - low > 1:
            middle = (low + high) // 2
            if lgamma(old + middle) - lgamma(old + fresh + middle) < bound:
                high = middle
            else:
                low = middle
        t += high <= n - done  # the next new table is the high-th from here
        done += high
    return t


def seat(n: np.ndarray, p: np.ndarray, concentration: float, discount: float, others: np.ndarray | float, r: np.random.Generator) -> np.ndarray:
    """Tables of dishes with n customers, base probability p and so many tables of other dishes around.

    All dishes side by side, one customer at a time; dish by dish once few are left.
    """
    n = n.astype(np.int64)
    t = np.minimum(n, 1).astype(np.float64)
    live = np.flatnonzero(n > 1)
    others = np.broadcast_to(np.asarray(others, dtype=np.float64), n.shape)
    done = 1
    while len(live) > FEW:
        fresh = (concentration + discount * (others[live] + t[live])) * p[live]
        t[live] += r.random(len(live)) * (fresh + np.maximum(done - discount * t[live], 1e-12)) < fresh
        done += 1
        live = live[n[live] > done]
    one = random.Random(int(r.integers(2**62)))
    for i in live.tolist():
        t[i] = _queue_up(int(n[i]), done, float(t[i]), float(p[i]), concentration, discount, float(others[i]), one)
    return t


class Spelling:
    """Predictive probabilities of letters after up to four classes of letters."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, cells: np.ndarray, n: np.ndarray, r: np.random.Generator, before: Spelling | None) -> Spelling:
        """One sweep over the restaurants, leaves first; ``before`` gives the parents' probabilities."""
        out = Spelling()
        keep = n > 0
        cells, n = cells[keep], n[keep].astype(np.float64)
        levels = []
        for m in range(ORDER, -1, -1):
            one, two = int((n == 1).sum()), int((n == 2).sum())
            cut = discount(one, two)
            context = cells >> 8
            parent = (context & ((1 << WIDTH[max(m - 1, 0)]) - 1)) << 8 | cells & 255
            p = before.of(parent, m - 1) if before is not None and m else np.full(len(cells), 1 / 256)
            rooms, room = np.unique(context, return_inverse=True)
            tables = np.bincount(room, minlength=len(rooms)).astype(np.float64)
            t = seat(n, p, CONCENTRATION, cut, tables[room] - 1, r)
            levels.append((m, cells, n, t, cut))
            if m:
                cells, place = np.unique(parent, return_inverse=True)
                n = np.bincount(place, weights=t, minlength=len(cells))
        for m, cells, n, t, cut in reversed(levels):
            rooms, room = np.unique(cells >> 8, return_inverse=True)
            seen, tables = np.bincount(room, weights=n, minlength=len(rooms)), np.bincount(room, weights=t, minlength=len(rooms))
            share = np.ones(1 << WIDTH[m], dtype=np.float32)  # of the parent's probabilities, in empty restaurants all
            share[rooms] = (CONCENTRATION + cut * tables) / (CONCENTRATION + seen)
            own = np.maximum(0, n - cut * t) / (CONCENTRATION + seen)[room]
            out.levels.append((cells, own.astype(np.float32), share))
        return out

    def of(self, cells: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Probabilities of cells of that order: each restaurant's own share on top of its parent's."""
        p = np.full(len(cells), 1 / 256)
        for m, (known, own, share) in enumerate(self.levels[: order + 1]):
            mine = (cells >> 8 & ((1 << WIDTH[m]) - 1)) << 8 | cells & 255
            at = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
            p = p * share[mine >> 8] + (np.where(known[at] == mine, own[at], 0) if len(known) else 0)
        return p

    def words(self, words: Words) -> np.ndarray:
        """Probability of each spelling."""
        if len(words.offsets) == 1:
            return np.zeros(0)
        cells, place, first, _ = words.letters()
        return np.exp(np.add.reduceat(np.log(self.of(cells))[place], first))


def _added(blobs: list[bytes]) -> bytes:
    scalars, keys, letters = zip(*(unpack(b, np.float64, np.int64, np.float64) for b in sorted(blobs)))
    cells, place = np.unique(np.concatenate(keys), return_inverse=True)
    return pack(np.sum(scalars, axis=0), cells, np.bincount(place, weights=np.concatenate(letters), minlength=len(cells)))


class State:
    """What one sweep leaves: spelling, customers and tables of the word restaurant, the seed and sample it was drawn with."""

    def __init__(self, spelling: Spelling, customers: float, tables: float, seed: int, sample: int) -> None:
        self.spelling, self.customers, self.tables, self.seed, self.sample = spelling, customers, tables, seed, sample


def word_probability(base: np.ndarray, customers: np.ndarray, tables: np.ndarray, state: State, discount: float) -> np.ndarray:
    return (np.maximum(0, customers - discount * tables) + (CONCENTRATION + discount * state.tables) * base) / (CONCENTRATION + state.customers)


def _queue(blob: bytes, sample: int) -> np.ndarray:
    return unpack(blob, *[np.int64] * SAMPLES)[sample]


def sweep(vocabulary: DataFrame, given: State, share: float, seed: int) -> State:
    """Seats the customers of all words anew, then the letters of all tables."""
    sample = seed % SAMPLES
    shared = vocabulary.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        for b in slices(batches, 1):
            for bucket, blob, queue in zip(*(b.column(c).to_pylist() for c in ("bucket", "vocabulary", "queue"))):
                customers = _queue(queue, sample)
                some = np.flatnonzero(customers)
                if not len(some):
                    continue
                data, sizes, _ = unpack(blob, np.uint8, np.uint32, np.int64)
                words = Words.unpacked(data, sizes).take(some)
                tables = draw(state, customers[some], state.spelling.words(words), share, seed, bucket)
                keys, place, _, size = words.letters()
                letters = np.bincount(place, weights=np.repeat(tables, size))
                yield pa.RecordBatch.from_arrays([pa.array([bucket % 8], pa.int32()), pa.array([pack(np.array([customers.sum(), tables.sum()], dtype=np.float64), keys, letters)], pa.binary())], ["lot", "sums"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"sums": pa.array([_added(table.column("sums").to_pylist())], pa.binary())})

    partial = vocabulary.select("bucket", "vocabulary", "queue").mapInArrow(run, "lot int, sums binary")
    got = [bytes(r[0]) for r in partial.groupBy("lot").applyInArrow(add, "sums binary").collect()]  # eight at most
    if not got:
        return given
    scalars, keys, letters = unpack(_added(got), np.float64, np.int64, np.float64)
    spelling = Spelling().fit(keys, letters, np.random.default_rng(seed), given.spelling if given.spelling.levels else None)
    return State(spelling, float(scalars[0]), float(scalars[1]), seed, sample)


def draw(given: State, customers: np.ndarray, base: np.ndarray, share: float, seed: int, bucket: int) -> np.ndarray:
    """Tables of words with so many customers, given the state before."""
    return seat(customers, base, CONCENTRATION, share, max(given.tables - 1, 0), np.random.default_rng(seed * 1_000_003 + bucket))


def word_answers(row: dict, chain: list[tuple[State, State]], share: float) -> pa.RecordBatch:
    """By page: count and averaged probability of each of its words in the bucket."""
    data, sizes, counts = unpack(row["vocabulary"], np.uint8, np.uint32, np.int64)
    words = Words.unpacked(data, sizes)
    mean = np.zeros(len(words))
    for given, state in chain:
        customers, tables = _queue(row["queue"], state.sample), np.zeros(len(words))
        some = np.flatnonzero(customers)
        if len(some):
            tables[some] = draw(given, customers[some], given.spelling.words(words.take(some)), share, state.seed, row["bucket"])
        mean += word_probability(state.spelling.words(words), customers, tables, state, share)
    mean = np.maximum(mean / len(chain), 1e-300)
    blobs = []
    for x in row["places"]:
        at = total(unpack(x, np.uint32)[0])
        blobs.append(pack(counts[at].astype(np.uint64), np.log(mean[at]).astype(np.float32)))
    bucket = pa.array(np.full(len(blobs), row["bucket"], dtype=np.int64))
    return pa.RecordBatch.from_arrays([pa.array(row["pages"], pa.int64()), bucket, pa.array(blobs, pa.binary())], ["page", "start", "reply"])


def lm_scores(docs: DataFrame, tokens: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity for every row of ``docs``.

    ``perplexity`` is 10 to the mean of the negative log10 probabilities of a
    text's tokens.  With ``tokens``, ``token_scores`` has all those logarithms.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "lm")
    paged = scratch.save(pages(docs), "pages")
    size, trained = paged.agg(F.sum("n_bytes"), F.sum("n_train")).first()
    size, trained = size or 0, trained or 0
    buckets, word_buckets = max(12, -(-size // BUCKET)), max(12, -(-size // WORD_BUCKET))
    often = paged.select(F.explode("often").alias("o")).groupBy("o.h").agg(F.sum("o.n").alias("n"))
    # at most HOT_SHARE contexts have that share of all tokens
    parts = (F.floor(2 * buckets * F.col("n") / F.lit(max(trained, 1))) + 1).cast("int")
    found = often.where(F.col("n") * HOT_SHARE >= trained).select("h", parts.alias("parts")).where("parts > 1").collect()
    hot = Hot([(r["h"], r["parts"]) for r in found], buckets)
    vocabulary = scratch.save(deal(paged, word_buckets).groupBy("bucket").applyInArrow(merge, VOCABULARY), "vocabulary")
    seated = pair_packs(paged, buckets, hot).groupBy("bucket").applyInArrow(lambda table: seat_bucket(table, word_buckets), SEATED)
    seated = scratch.save(seated, "seated")
    masses = seated.where("mass is not null").groupBy("hot").agg(F.sum("mass").alias("mass")).collect()  # as many as in ``hot`` at most
    sent = seated.where("customers is not null").select("bucket", "customers")
    whole = vocabulary.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(with_customers, VOCABULARY + ", queue binary, once array<bigint>")
    vocabulary = scratch.save(whole.repartition(word_buckets, "bucket"), "customers")  # every sweep reads it: not in a few files
    known, one, two = vocabulary.agg(F.sum("known"), F.sum(F.col("once")[0]), F.sum(F.col("once")[1])).first()
    share, known = discount(one or 0, two or 0), known or 0
    state = State(Spelling(), 0.0, 0.0, 0, 0)
    chain = []
    for k in range(1, BURN_IN + SAMPLES + 1):
        before, state = state, sweep(vocabulary, state, share, k)
        if k > BURN_IN:
            chain.append((before, state))
    shared = spark.sparkContext.broadcast((chain, share, {r["hot"]: r["mass"] for r in masses}))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            for row in b.to_pylist():
                yield word_answers(row, *shared.value[:2])

    answers = vocabulary.select("bucket", "vocabulary", "queue", "pages", "places").mapInArrow(answer, "page bigint, start bigint, reply binary")
    of_words = answers.select("page", F.lit(True).alias("of_words"), "start", F.lit(None).cast("bigint").alias("hot"), "reply")
    replies = of_words.unionByName(seated.where("reply is not null").select("page", F.lit(False).alias("of_words"), "start", "hot", "reply"))
    norm = trained + 0.5 * (known + 1)

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        sizes, out, codes = unpack(left.column("codes")[0].as_py(), np.uint32, np.uint8, np.uint32)
        rows = sorted(zip(*(right.column(c).to_pylist() for c in ("start", "of_words", "hot", "reply"))), key=lambda x: x[:2])
        counts, p = (np.concatenate(c) for c in zip(*(unpack(r, np.uint64, np.float32) for _, word, _, r in rows if word)))
        counts, p = counts.astype(np.int64), np.exp(p.astype(np.float64))
        u, w, place = pairs_of(codes, sizes, len(counts))
        own, mass = np.zeros(len(u)), np.zeros(len(counts))
        for start, word, heat, reply in rows:
            if not word:
                (d,), n, more, rooms = unpack(reply, np.float64, np.uint32, np.uint32, np.uint32)
                seen = n.astype(np.float64)
                own[start : start + len(n)] = np.maximum(0, seen - d * (np.minimum(seen, 1) + more / SAMPLES))
                here = u[start : start + len(n)]
                mass[here[np.flatnonzero(np.diff(here, prepend=-1))]] = d * rooms / SAMPLES if heat is None else shared.value[2][heat] / SAMPLES
        logs = np.log10((own + (LEAF_CONCENTRATION + mass[u]) * p[w]) / (LEAF_CONCENTRATION + counts[u]))
        first = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))[:-1]])
        ids = pa.ipc.open_stream(left.column("ids")[0].as_py()).read_all().column("doc_id").combine_chunks()
        score, n = np.add.reduceat(logs[place], first), len(sizes)
        columns = {
            "doc_id": ids, "held_out": pa.array(out.astype(bool)), "n_tokens": pa.array(sizes.astype(np.int64)),
            "n_known": pa.array(np.add.reduceat((counts > 0).astype(np.int64)[codes], first)), "train_tokens": pa.array(np.full(n, trained, np.int64)),
            "base_score": pa.array(np.add.reduceat(np.log10((counts + 0.5) / norm)[codes], first)), "score": pa.array(score),
            "perplexity": pa.array(10 ** np.minimum(-score / sizes, 300)),
        }
        if tokens:
            columns["token_scores"] = pa.ListArray.from_arrays(pa.array(np.append(first, len(codes)).astype(np.int32)), pa.array(logs[place]))
        return pa.table(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    return paged.select("page", "codes", "ids").groupBy("page").cogroup(replies.groupBy("page")).applyInArrow(finish, out + ", token_scores array<double>" * tokens)


def op7(docs: DataFrame) -> DataFrame:
    return lm_scores(docs)
