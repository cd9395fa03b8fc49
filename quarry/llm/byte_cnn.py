"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes run over the UTF-8 bytes of the whole text.  Their
highest responses within chunks of ``2 * BLOCK`` bytes that overlap by half
describe each chunk, a small hidden layer looks at every chunk, and the mean
and the maximum over all chunks give one probability.  A response is a sum of
table look-ups, one a byte, so no text is ever one-hot encoded.

Training takes a bounded sample of labelled rows: at most ``SAMPLE`` of each
class, those whose ids have the lowest hashes, and of these, in that order, as
many as fit into ``SAMPLE_BYTES``.  Every text of it is learnt from whole; one
that doesn't fit is left out.  This bounds the driver's work whatever the corpus.
Scoring is one narrow pass over all texts, whole, in pieces of bounded size.

Labels are learnt from rows whose crc32 of the id modulo ``FOLDS`` isn't 0; the
others are held out.  The share of each class among all those labels sets the
prior.  Neither labels nor ids, languages or sources enter a score.

Nulls: a null text scores as the empty text, which is one chunk of a zero byte;
null labels teach nothing; a null doc_id hashes as the empty string.  Repeated
rows are scored one by one.  Without labels of both classes every score is the
prior.  Empty tables give empty results, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

WIDTH, FILTERS, HIDDEN, BLOCK = 8, 24, 16, 256
SAMPLE, SAMPLE_BYTES = 1500, 12_000_000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Blocks convolved at once: 6 MB of responses.
AT_ONCE = 256


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


class Layout:
    """Texts as blocks of bytes: each begins a block, and what follows its end is zero."""

    def __init__(self, texts: list[bytes]) -> None:
        size = np.array([max(1, len(t)) for t in texts], dtype=np.int64)
        self.blocks = -(-size // BLOCK)
        room = -(-(size + WIDTH - 1) // BLOCK)  # a window at the end of a text must not see the next text
        self.first = np.concatenate([[0], np.cumsum(room)])
        total = int(self.first[-1])
        self.bytes = np.zeros((total + 1) * BLOCK, dtype=np.uint8)
        for t, b in zip(texts, self.first):
            self.bytes[b * BLOCK : b * BLOCK + len(t)] = np.frombuffer(t, dtype=np.uint8)
        owner = np.repeat(np.arange(len(texts)), room)
        left = size[owner] - (np.arange(total) - self.first[owner]) * BLOCK
        self.starts = np.clip(left, 0, BLOCK)  # window starts inside the text, of each block
        last = np.zeros(total, dtype=bool)  # of its text
        last[self.first[:-1] + self.blocks - 1] = True
        # one chunk from each block to the next; a text of one block is one chunk
        alone = self.blocks[owner] == 1
        self.chunk = np.flatnonzero((self.starts > 0) & (~last | alone))
        self.next = np.where(last[self.chunk], self.chunk, self.chunk + 1)
        self.chunks = np.maximum(1, self.blocks - 1)
        self.first_chunk = np.concatenate([[0], np.cumsum(self.chunks)[:-1]])


def block_maxima(x: Layout, table: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The highest response of every filter in every block, and where it is."""
    total = len(x.starts)
    out = np.empty((total, table.shape[2]), dtype=np.float32)
    where = np.empty(out.shape, dtype=np.int64) if places else None
    place = np.arange(BLOCK)
    for a in range(0, total, AT_ONCE):
        z = min(total, a + AT_ONCE)
        window = x.bytes[a * BLOCK : z * BLOCK + WIDTH]
        n = (z - a) * BLOCK
        y = table[0][window[:n]]
        for k in range(1, WIDTH):
            y += table[k][window[k : n + k]]
        y = y.reshape(z - a, BLOCK, -1)
        short = np.flatnonzero(x.starts[a:z] < BLOCK)
        if len(short):
            y[short] = np.where((place[None, :] < x.starts[a:z][short][:, None])[:, :, None], y[short], -np.inf)
        out[a:z] = y.max(axis=1)
        if places:
            where[a:z] = y.argmax(axis=1) + (np.arange(a, z) * BLOCK)[:, None]
    return out, where


class Network:
    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.4, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.w1, self.b1 = r.normal(0, 0.2, (FILTERS, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = r.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.w1, self.b1, self.w2, self.b2]

    def head(self, x: Layout, blocks: np.ndarray):
        chunk = np.maximum(blocks[x.chunk], blocks[x.next]).astype(np.float64)
        squashed = np.tanh(chunk / 2)
        hidden = np.maximum(0, squashed @ self.w1 + self.b1)
        mean = np.add.reduceat(hidden, x.first_chunk) / x.chunks[:, None]
        top = np.maximum.reduceat(hidden, x.first_chunk)
        return squashed, hidden, mean, top, np.concatenate([mean, top], axis=1) @ self.w2 + self.b2[0]

    def logits(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = Layout(texts)
        return self.head(x, block_maxima(x, self.table)[0])[-1]

    def gradients(self, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
        x = Layout(texts)
        blocks, where = block_maxima(x, self.table, places=True)
        squashed, hidden, mean, top, z = self.head(x, blocks)
        dz = (1 / (1 + np.exp(-z)) - y) / len(y)
        dw2, db2 = np.concatenate([mean, top], axis=1).T @ dz, np.array([dz.sum()])
        owner = np.repeat(np.arange(len(texts)), x.chunks)
        dh = (dz[:, None] * self.w2[:HIDDEN])[owner] / x.chunks[owner][:, None]
        highest = hidden == top[owner]
        dh += np.where(highest, (dz[:, None] * self.w2[HIDDEN:])[owner], 0)
        dh *= hidden > 0
        dw1, db1 = squashed.T @ dh, dh.sum(axis=0)
        dc = (dh @ self.w1.T) * (1 - squashed**2) / 2
        from_next = blocks[x.next] > blocks[x.chunk]
        at = np.where(from_next, where[x.next], where[x.chunk])
        dt = np.zeros(self.table.size)
        f = np.broadcast_to(np.arange(FILTERS), at.shape)
        for k in range(WIDTH):
            cell = (k * 256 + x.bytes[at + k].astype(np.int64)) * FILTERS + f
            dt += np.bincount(cell.ravel(), weights=dc.ravel(), minlength=dt.size)
        return [dt.reshape(self.table.shape), dw1, db1, dw2, db2]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on the cross-entropy."""
    net, r = Network(seed), np.random.default_rng(seed)
    moments = [[np.zeros(p.shape), np.zeros(p.shape)] for p in net.parts()]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for k in range(0, len(order), batch):
            step += 1
            own = order[k : k + batch]
            for p, g, (m, v) in zip(net.parts(), net.gradients([texts[i] for i in own], labels[own]), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * 0.8**epoch * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    return net


def fitting(rows: list[tuple[int, int]], limit: int) -> set[int]:
    """Of (hash, bytes) those hashes whose texts fit into ``limit``, in order."""
    chosen, left = set(), limit
    for h, size in rows:
        if h not in chosen and size <= left:
            chosen.add(h)
            left -= size
    return chosen


def sample(docs: DataFrame, labels: DataFrame, limit: int | None = None) -> tuple[list[bytes], np.ndarray, float]:
    """Texts, labels, and the share of label 1 among all that may be learnt from."""
    known = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT)).select("doc_id", F.col("quality").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.unionByName(part)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t")).join(F.broadcast(chosen.distinct()), "doc_id")  # at most 2 * SAMPLE ids
    found = Scratch(docs.sparkSession, "quality").save(rows.select("t", "y", F.xxhash64("t", "y").alias("h"), F.octet_length("t").alias("size")), "sample")
    # equal texts of one label teach once; ids that repeat can't exceed the bound
    sizes = found.groupBy("h").agg(F.first("size").alias("size")).orderBy("h").limit(2 * SAMPLE).collect()
    hashes = fitting([(r["h"], r["size"]) for r in sizes], SAMPLE_BYTES if limit is None else limit)
    got = found.where(F.col("h").isin(list(hashes))).dropDuplicates(["h"]).orderBy("h").select("t", "y").collect()
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return [r["t"].encode() for r in got], np.array([r["y"] for r in got], dtype=float), share


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score for every row of ``docs``."""
    texts, y, share = sample(docs, labels)
    both = 0 < y.sum() < len(y)
    net = train(texts, y) if both else None
    # the sample has both classes alike often; the corpus hasn't
    shift = np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())) if both and 0 < share < 1 else 0.0
    constant = min(max(share, 0.0), 1.0) if len(y) else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            scores: list[float] = []
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            at = 0
            while at < len(texts):  # about 4 MB at once, or one text
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 4 << 20):
                    size += len(texts[end]) + BLOCK
                    end += 1
                z = net.logits(texts[at:end]) + shift if net else np.full(end - at, np.nan)
                scores.extend(1 / (1 + np.exp(-np.clip(z, -500, 500))) if net else [constant] * (end - at))
                at = end
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_scores(docs, labels).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
