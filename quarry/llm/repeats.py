"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier.

Equal 100-byte windows must meet without sorting all suffixes of the corpus.
Every window has an anchor, the position of its lowest ``GRAM``-byte hash
(leftmost, if it recurs); equal windows have equal anchors at equal offsets.
Windows that follow each other share an anchor, about 35 of them, so anchors are
few, and a window can repeat only where its anchor's hash does.

1. Texts are packed into pages of about ``PAGE`` bytes, all columns along, which
   are written once.  Of anchors that recur within a page with the same context
   (all their windows), an index as in step 3 finds the windows that repeat; the
   first goes to the bucket of its hash: 26 bytes in packed arrays.  A page sends
   such an anchor once, so a passage in a third of all documents is one entry a page.
2. In a bucket, occurrences on several pages of an anchor with the same context
   are repeats but for the first; 128 bits of hashes decide that.  Where several contexts share an anchor, the
   first occurrence of each is asked for its bytes.
3. Of a bucket's contexts, windows whose bytes around the anchor recur are put behind each other in document order and
   indexed: suffixes are ordered by their first bytes, by doubling, the
   Burrows-Wheeler transform is read off, and breadth-first backward extension
   of intervals finds the boundaries with common prefixes of 0, 1, 2, ... bytes.
   It stops at ``LENGTH``: where no boundary was found, neighbours share that
   many bytes at least.  Of each class of equal windows all but the first repeat.
   An anchor with more than ``CROWD`` contexts is dealt out by the bytes that
   groups of eight windows have in common, so that no bucket need hold it whole.
4. Each page is read again with what was found for it, and cut.

"Earlier" is: smaller doc_id, then earlier start.  A null doc_id comes first;
rows of equal ids follow in the order of the input, as do text ids that have
their first eight bytes in common.  Null texts are empty.
Windows never cross rows.  Contexts are told apart by 128 bits of hashes.
Repeated rows are repeats of the first.  Empty tables give empty results.  All
columns of the input are kept by ``find_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
PAGE, PAGE_ROWS = 2_000_000, 8192
#: Bytes of text a bucket of anchors, and of contexts a bucket of those, stands for.
BUCKET, INDEX = 24_000_000, 2_000_000
CROWD, CLASS = 20_000, 8

_U = np.uint64
_TABLE = np.random.default_rng(9).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = (1 << 32) - 1  # more than a text can have


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h = h * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(29))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class Hashes:
    """Hashes of any substring of a buffer, from running sums."""

    def __init__(self, x: np.ndarray) -> None:
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[x] * _powers(_BASE, len(x)), dtype=np.uint64)])
        self.inverse = _powers(_INVERSE, len(x) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def anchors(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts behind each other: anchor position, first and last window start, hash, hash of the context."""
    none = np.zeros(0, np.int64)
    if len(x) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h, step, factor = _TABLE[x], 1, 0xA24BAED4963EE407
    while step < GRAM:
        h = h[:-step] * _U(factor) + h[step:]
        h ^= h >> _U(32)
        step, factor = 2 * step, factor * factor % 2**64
    h = _mixed(h)
    low = (h & ~_U(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= SPAN:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: len(low) - (SPAN - step)], low[SPAN - step :])
    at = (low & _U(_PLACE)).astype(np.int64)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(at)]
    inside = np.arange(len(at)) + LENGTH <= end
    change = at[1:] != at[:-1]
    first = np.flatnonzero(inside & np.concatenate([[True], change | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([change | ~inside[1:], [True]]))
    p = at[first]
    context = Hashes(x).of(first, last + LENGTH)
    context = _mixed(context + (p - first).astype(np.uint64) * _U(0x100000001B3) + (last - first).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return p, first, last, h[p], context


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as one compressed string."""
    return zstandard.compress(np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unblob(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _ids(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Numbers in the order of the ids: integers themselves, of others the first eight bytes; null comes first."""
    column = batch.column("doc_id")
    values = column.to_pylist()
    if pa.types.is_integer(column.type):
        return np.array([-(2**63) if v is None else v for v in values], dtype=np.int64)
    heads = [(v if isinstance(v, bytes) else str(v).encode())[:8].ljust(8, b"\0") for v in ("" if v is None else v for v in values)]
    return np.array([int.from_bytes(x, "big") - 2**63 for x in heads], dtype=np.int64)


def _unpack(blob: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A page: its rows, their ids, the texts' bytes, the texts' offsets."""
    table = pa.ipc.open_stream(blob).read_all()
    texts = [(t or "").encode() for t in table.column("text").to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return table, _ids(table), np.frombuffer(b"".join(texts), dtype=np.uint8), offsets


def pages(docs: DataFrame, page_bytes: int = PAGE) -> DataFrame:
    """page, n_bytes, blob: rows in order of doc_id, as compressed Arrow streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal page, size, rows
            t = pa.Table.from_batches(held)
            ids = _ids(t)
            t = t.take(pa.array(np.argsort(ids, kind="stable")))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
                w.write_table(t)
            out = pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["page", "n_bytes", "blob"])
            held.clear()
            page, size, rows = page + 1, 0, 0
            return out

        for b in batches:
            lengths = [len((t or "").encode()) for t in b.column("text").to_pylist()]
            start = 0
            for i, n in enumerate(lengths):
                if rows and (size + n > page_bytes or rows == PAGE_ROWS):
                    if i > start:
                        held.append(b.slice(start, i - start))
                    start = i
                    yield flush()
                size, rows = size + n, rows + 1
            held.append(b.slice(start))
        if rows:
            yield flush()

    return docs.mapInArrow(run, "page bigint, n_bytes bigint, blob binary")


_ENTRY = (np.uint64, np.uint64, np.int64, np.uint32, np.uint8, np.uint8)


def anchor_packs(paged: DataFrame, buckets: int, index: int = INDEX) -> DataFrame:
    """bucket, page, entries, local: what a page has for each bucket, and ranges that repeat within the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, blob in zip(b.column("page").to_pylist(), b.column("blob")):
                _, ids, x, offsets = _unpack(blob.as_buffer())
                p, first, last, h, context = anchors(x, offsets)
                order = np.lexsort((np.arange(len(p)), context, h))
                new = np.ones(len(p), dtype=bool)
                if len(p):
                    new[1:] = (h[order][1:] != h[order][:-1]) | (context[order][1:] != context[order][:-1])
                twice = ~new
                twice[:-1] |= ~new[1:]
                some = np.sort(order[twice])
                begin, last_ = repeats_in_page(x, first[some], last[some], h[some], index)
                local = _blob(begin.astype(np.uint32), (last_ + LENGTH).astype(np.uint32))
                gone = np.zeros(len(x) + 2, dtype=np.int64)
                np.add.at(gone, begin, 1)
                np.add.at(gone, last_ + 1, -1)
                gone = np.concatenate([[0], np.cumsum(np.cumsum(gone) > 0)])  # windows before each place that are repeats
                again = gone[last + 1] - gone[first] == last - first + 1
                again[order[new]] = False  # the first of each context is sent on, the others if they aren't repeats throughout
                keep = np.flatnonzero(~again)
                owner = np.searchsorted(offsets, first, side="right") - 1
                bucket = (h[keep] % _U(buckets)).astype(np.int64)
                rows = []
                for k, part in _by_page(bucket):
                    i = keep[part]
                    rows.append((k, page, _blob(h[i], context[i], ids[owner[i]], first[i].astype(np.uint32), (p[i] - first[i]).astype(np.uint8), (last[i] - first[i]).astype(np.uint8)), None))
                if len(begin):
                    rows.append((page % buckets, page, _blob(*[np.zeros(0, k) for k in _ENTRY]), local))
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], ["bucket", "page", "entries", "local"])

    return paged.select("page", "blob").mapInArrow(run, "bucket int, page bigint, entries binary, local binary")


def _by_page(page: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(page, kind="stable")
    cuts = np.flatnonzero(np.diff(page[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(page[part[0]]), part


def resolve(table: pa.Table, crowd: int = CROWD) -> pa.Table:
    """A bucket of anchors: by page, ranges that repeat and contexts whose bytes are needed."""
    parts, pages_, out = [], [], []
    for page, entries, local in zip(*(table.column(c).to_pylist() for c in ("page", "entries", "local"))):
        parts.append(_unblob(entries, *_ENTRY))
        pages_.append(np.full(len(parts[-1][0]), page, dtype=np.int64))
        if local is not None:
            out.append((page, local, None, 0))
    h, context, ids, first, back, more = (np.concatenate(c) for c in zip(*parts))
    page = np.concatenate(pages_)
    order = np.lexsort((first, page, ids, context, h))
    h, context, first, back, more, page = (a[order] for a in (h, context, first, back, more, page))
    new_h = np.ones(len(h), dtype=bool)
    new_h[1:] = h[1:] != h[:-1]
    new = new_h.copy()
    new[1:] |= context[1:] != context[:-1]
    group = np.cumsum(new_h) - 1
    contexts = np.bincount(group, weights=new)
    asked = new & (contexts[group] > 1)
    crowded = contexts[group] > crowd
    for k, i in _by_page(page):
        found = i[~new[i]]
        wanted = i[asked[i]]
        if len(found) or len(wanted):
            ranges = _blob(first[found], first[found] + more[found] + np.uint32(LENGTH)) if len(found) else None
            request = _blob(first[wanted], back[wanted], more[wanted], h[wanted], crowded[wanted].astype(np.uint8)) if len(wanted) else None
            out.append((k, ranges, request, int((more[wanted].astype(np.int64) + LENGTH).sum())))
    c = list(zip(*out)) or [()] * 4
    return pa.table({"page": pa.array(c[0], pa.int64()), "ranges": pa.array(c[1], pa.binary()), "request": pa.array(c[2], pa.binary()), "asked": pa.array(c[3], pa.int64())})


def _slices(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many ranges behind each other."""
    at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return x[at]


def _class(sums: Hashes, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Windows from low to high that start k to k + 7 bytes before their anchor: first, last, if any, and a hash of the bytes that they share."""
    a, z = np.maximum(low, anchor - (k + CLASS - 1)), np.minimum(high, anchor - k)
    ok = a <= z
    common = anchor[ok] - k
    return a, z, ok, _mixed(sums.of(common, common + LENGTH - CLASS + 1) + _U(k))


def _worth_indexing(x: np.ndarray, start: np.ndarray, size: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts (ranges of ``x``): context, first and last window of each run of classes whose shared bytes occur in another context.

    Equal windows share them, so nothing that repeats is left out; what merely
    has an anchor in common needs no index.
    """
    classes = range(0, SPAN, CLASS)
    sums, anchor = Hashes(x), start + back
    keep = np.zeros((len(start), len(classes) + 2), dtype=bool)
    lows, highs = (np.zeros((len(start), len(classes)), dtype=np.int64) for _ in range(2))
    for j, k in enumerate(classes):
        lows[:, j], highs[:, j], ok, common = _class(sums, start, start + size - LENGTH, anchor, k)
        _, place, count = np.unique(common, return_inverse=True, return_counts=True)
        keep[np.flatnonzero(ok), j + 1] = count[place] > 1
    edges = np.diff(keep.astype(np.int8), axis=1)
    own, begin = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    return own, lows[own, end - 1], highs[own, begin]


def context_packs(joined: DataFrame, buckets: int) -> DataFrame:
    """bucket, page, contexts: the bytes that were asked for.  ``joined`` has page, blob, requests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, blob, requests in zip(b.column("page").to_pylist(), b.column("blob"), b.column("requests").to_pylist()):
                _, ids, x, offsets = _unpack(blob.as_buffer())
                first, back, more, h, crowded = (np.concatenate(c) for c in zip(*(_unblob(r, np.uint32, np.uint8, np.uint8, np.uint64, np.uint8) for r in requests)))
                first, back, more = first.astype(np.int64), back.astype(np.int64), more.astype(np.int64)
                low, high, key, anchor = first, first + more, h, first + back
                hot = np.flatnonzero(crowded)
                if len(hot):  # windows by offset of the anchor, eight at a time, with the bytes that they share
                    sums, parts = Hashes(x), []
                    for k in range(0, SPAN, CLASS):
                        a, z, ok, common = _class(sums, low[hot], high[hot], anchor[hot], k)
                        parts.append((a[ok], z[ok], _mixed(h[hot][ok] + common), anchor[hot][ok]))
                    cold = crowded == 0
                    low, high, key, anchor = (np.concatenate([base[cold], *(p[i] for p in parts)]) for i, base in enumerate((low, high, key, anchor)))
                order = np.argsort(low, kind="stable")
                low, high, key, anchor = low[order], high[order], key[order], anchor[order]
                owner = np.searchsorted(offsets, low, side="right") - 1
                bucket = (_mixed(key) % _U(buckets)).astype(np.int64)
                rows = []
                for k, i in _by_page(bucket):
                    size = high[i] - low[i] + LENGTH
                    head = _blob(ids[owner[i]], low[i].astype(np.uint32), (anchor[i] - low[i]).astype(np.int8), size.astype(np.uint8))
                    rows.append((k, page, head, zstandard.compress(_slices(x, low[i], size).tobytes(), 1)))
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], ["bucket", "page", "head", "body"])

    return joined.select("page", "blob", "requests").mapInArrow(run, "bucket int, page bigint, head binary, body binary")


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``t`` (values below 512, the last one 0 and only there) ordered by their first ``depth`` values at least."""
    n = len(t)
    padded = np.concatenate([t, np.zeros(7, t.dtype)]).astype(np.int64)
    key = np.zeros(n, dtype=np.int64)
    for k in range(7):
        key = key << 9 | padded[k : k + n]
    known = 7
    while True:
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.ones(n, dtype=np.int64)
        new[1:] = s[1:] != s[:-1]
        if known >= depth or new.all():
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        key = rank * (n + 1)
        key[:-known] += rank[known:]
        known *= 2


def same_prefix_classes(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each rank the number of its class: equal in the first ``length`` values.

    Breadth-first backward extension: an interval of suffixes that begin with
    some w of l values, extended to the left by c, ends at a boundary where
    neighbours have l values in common, unless a shorter prefix claimed it.
    """
    n = len(t)
    order = suffix_order(t, length)
    bwt = t[order - 1].astype(np.int64)  # the position before the first is the final 0
    sorted_by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, dtype=np.int64)
    lf[sorted_by] = np.arange(n)
    keys = bwt[sorted_by] * n + sorted_by
    following = np.full(n, n, dtype=np.int64)
    same = bwt[sorted_by][1:] == bwt[sorted_by][:-1]
    following[sorted_by[:-1][same]] = sorted_by[1:][same]
    common = np.full(n + 1, -1, dtype=np.int16)
    common[0] = common[n] = 0
    left, right = np.array([0]), np.array([n])
    for l in range(length):
        if not len(left):
            break
        size = right - left
        place = np.repeat(left - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        ends = np.repeat(right, size)
        closing = following[place] >= ends  # the last of its value in the interval
        place, begins = place[closing], np.repeat(left, size)[closing]
        boundary = lf[place] + 1
        fresh = common[boundary] < 0
        place, begins, boundary = place[fresh], begins[fresh], boundary[fresh]
        common[boundary] = l
        left, right = np.searchsorted(keys, bwt[place] * n + begins), boundary
    return order, np.cumsum(common[:n] >= 0) - 1


def repeated_runs(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ranges of ``x`` in document order: range, first and last start in it of each run of windows that have an earlier equal."""
    t = np.concatenate([_slices(x, start, size).astype(np.int16) + 1, np.zeros(1, np.int16)])
    owner = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    window = np.concatenate([offset + LENGTH <= size[owner], [False]])
    ranks, kind = same_prefix_classes(t, LENGTH)
    place = np.where(window[ranks], ranks, len(t))
    lowest = np.minimum.reduceat(place, np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])))
    again = np.sort(ranks[window[ranks] & (place > lowest[kind])])
    if not len(again):
        return again, again, again
    new = np.concatenate([[True], (np.diff(again) > 1) | (np.diff(owner[again]) > 0)])
    first, last = again[new], again[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(again) - 1]])]
    return owner[first], offset[first], offset[last]


def repeats_in_page(x: np.ndarray, first: np.ndarray, last: np.ndarray, h: np.ndarray, index: int = INDEX) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the runs of windows, of these contexts of a page, that have an earlier equal among them.

    Equal windows have equal anchors, so contexts are dealt by anchor, and an
    index never has much more than ``index`` bytes unless one anchor does.
    """
    parts = -(-int((last - first + LENGTH).sum()) // index) if len(first) else 0
    lot = (_mixed(h) % _U(max(1, parts))).astype(np.int64)
    begins, ends = [], []
    for k in range(parts):
        i = np.flatnonzero(lot == k)
        if not len(i):
            continue
        new = np.concatenate([[True], first[i][1:] > last[i][:-1] + 1])  # neighbours go in one range
        start, end = first[i][new], last[i][np.concatenate([np.flatnonzero(new)[1:] - 1, [len(i) - 1]])]
        run, begin, stop = repeated_runs(x, start, end - start + LENGTH)
        begins.append(start[run] + begin)
        ends.append(start[run] + stop)
    return (np.concatenate(begins), np.concatenate(ends)) if begins else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def index_bucket(table: pa.Table) -> pa.Table:
    """A bucket of contexts: by page, ranges of windows that have an earlier equal."""
    heads, pages_, bodies = [], [], []
    for page, head, body in zip(*(table.column(c).to_pylist() for c in ("page", "head", "body"))):
        heads.append(_unblob(head, np.int64, np.uint32, np.int8, np.uint8))
        pages_.append(np.full(len(heads[-1][0]), page, dtype=np.int64))
        bodies.append(np.frombuffer(zstandard.decompress(body), dtype=np.uint8))
    ids, low, back, size = (np.concatenate(c) for c in zip(*heads))
    page, x, size = np.concatenate(pages_), np.concatenate(bodies), size.astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    own, first, last = _worth_indexing(x, start, size, back.astype(np.int64))
    if not len(own):
        return pa.table({"page": pa.array([], pa.int64()), "ranges": pa.array([], pa.binary())})
    ids, page, low, start, size = ids[own], page[own], low[own] + (first - start[own]), first, last - first + LENGTH
    order = np.lexsort((low, page, ids))
    page, low, size = page[order], low[order].astype(np.int64), size[order]
    run, begin, last = repeated_runs(x, start[order], size)
    out = []
    for k, i in _by_page(page[run]):
        out.append((k, _blob((low[run] + begin)[i].astype(np.uint32), (low[run] + last + LENGTH)[i].astype(np.uint32))))
    c = list(zip(*out)) or [(), ()]
    return pa.table({"page": pa.array(c[0], pa.int64()), "ranges": pa.array(c[1], pa.binary())})


def _cut(blob: pa.Buffer, found: list[bytes] | None) -> tuple[pa.Table, list[int], list[int], list[int], list[bytes]]:
    """A page's rows with bytes, removed bytes, removed runs and kept bytes of each."""
    table, _, x, offsets = _unpack(blob)
    gone = np.zeros(len(x) + 1, dtype=np.int64)
    for ranges in found or ():
        a, z = _unblob(ranges, np.uint32, np.uint32)
        np.add.at(gone, a, 1)
        np.add.at(gone, z, -1)
    covered = np.cumsum(gone)[:-1] > 0
    sizes, removed, spans, kept = [], [], [], []
    for a, z in zip(offsets, offsets[1:]):
        c = covered[a:z]
        sizes.append(int(z - a))
        removed.append(int(c.sum()))
        spans.append(int(c[0]) + int((c[1:] & ~c[:-1]).sum()) if z > a else 0)
        kept.append(x[a:z][~c].tobytes())
    return table, sizes, removed, spans, kept


def located(docs: DataFrame, scratch: Scratch, page_bytes: int = PAGE, bucket: int = BUCKET, index: int = INDEX, crowd: int = CROWD) -> DataFrame:
    """page, blob, found: the pages of ``docs`` with the ranges that repeat earlier ones."""
    paged = scratch.save(pages(docs, page_bytes), "pages")
    total = paged.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, -(-total // bucket))
    packs = anchor_packs(paged, buckets, index)
    resolved = packs.groupBy("bucket").applyInArrow(lambda table: resolve(table, crowd), "page bigint, ranges binary, request binary, asked bigint")
    resolved = scratch.save(resolved, "resolved")
    asked = resolved.agg(F.sum("asked")).first()[0] or 0
    ranges = resolved.where("ranges is not null").select("page", "ranges")
    if asked:
        requests = resolved.where("request is not null").groupBy("page").agg(F.collect_list("request").alias("requests"))
        wanted = context_packs(paged.join(requests, "page"), max(8, -(-asked // index)))
        more = wanted.groupBy("bucket").applyInArrow(index_bucket, "page bigint, ranges binary")
        ranges = ranges.unionByName(scratch.save(more, "indexed"))
    found = ranges.groupBy("page").agg(F.collect_list("ranges").alias("found"))
    return paged.select("page", "blob").join(found, "page", "left")


def find_repeats(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its columns in a struct ``row``, and n_bytes, n_removed, n_spans, kept (bytes)."""
    scratch = Scratch(docs.sparkSession, "repeats")
    names = docs.columns
    schema = docs.schema.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, found in zip(b.column("blob"), b.column("found").to_pylist()):
                table, sizes, removed, spans, kept = _cut(blob.as_buffer(), found)
                row = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in names], fields=[table.schema.field(c) for c in names])
                yield pa.RecordBatch.from_arrays([row, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    out = located(docs, scratch).select("blob", "found").mapInArrow(run, f"row {schema}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes cut out of the texts; what a cut leaves of a character goes too.

    ``n_chars``, if there is such a column, follows the text.  Rows whose whole
    text is cut go; rows that were empty before stay.
    """
    found = find_repeats(docs).where((F.col("n_bytes") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    whole = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    found = found.withColumn("cut", F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(whole))
    chars = F.when(F.col("n_removed") == 0, F.col("row")["n_chars"]).otherwise(F.char_length("cut").cast("bigint")) if "n_chars" in docs.columns else None
    new = {"text": F.col("cut"), "n_chars": chars}
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def op9(docs: DataFrame, **sizes: int) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scratch = Scratch(docs.sparkSession, "repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, found in zip(b.column("blob"), b.column("found").to_pylist()):
                table, sizes, removed, spans, kept = _cut(blob.as_buffer(), found)
                digests = [hashlib.sha256(k).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = located(slim, scratch, **sizes).select("blob", "found").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out
