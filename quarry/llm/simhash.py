"""SimHash near-dedup with pivot distance tables.

A 64-bit fingerprint sums up the hashed shingles of a text: a bit is 1 if it is
set in more than half of the hashes.  Texts link at ``max_distance`` or fewer
differing bits, and linked texts are one group.

Equal fingerprints are collapsed first, so a group of copies is one row.  For
the distinct ones a table holds the Hamming distances to many pivots.  Pivots
come in families: a random fingerprint, and that fingerprint with one block of
bits inverted.  A column less its mirrored column says how far a fingerprint is
from the pivot inside the block, and the differences over all families of a
block make a cell number.  Of ``blocks`` blocks, fingerprints within
``max_distance`` bits agree on ``blocks - max_distance`` at least, so they meet
in a cell of one of these combinations: no link is lost.  Inside a cell the
triangle inequality discards every pair with a coordinate difference above
``max_distance``, as part of the join's condition, and the survivors are
verified bit by bit.

A cell with more than ``crowd`` fingerprints (a large family of near copies) is
taken apart exactly: the bits outside the cell's blocks are cut into slivers of
``SLIVER`` bits, and all but ``max_distance`` slivers must agree as well, which
leaves at most ``2 ** (SLIVER * max_distance)`` fingerprints that share a key.

``drop_near_copies`` gives every text many fingerprints, each of a sample of its
shingles, and links them in the same tables; see there.

Nulls: a null text counts as empty; texts without words have fingerprint zero
and link like any other.  A null doc_id keeps its row and is ignored when the
smallest doc_id of a group is sought.  Repeated rows are members like any
other.  An empty table gives an empty result.  Other columns are ignored, and
kept by ``drop_near_copies``.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import Scratch, slices
from .components import components

BITS, SEED = 64, 42
#: Families of mirrored pivots for each block, and plain pivots that only discard.
FAMILIES, PLAIN = 6, 9
SLIVER = 3


def fingerprint(normal: bytes, shingle: int) -> int:
    """Of words joined by single spaces, in UTF-8."""
    if not normal:
        return 0
    w = normal.split(b" ")
    if len(w) < shingle:
        return xxhash.xxh64_intdigest(normal, SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.fromiter((digest(join(x), SEED) for x in zip(*(w[i:] for i in range(shingle)))), dtype=np.uint64, count=len(w) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 65536):  # the bits of a very long text are counted in pieces
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def normal_words(texts: pa.Array) -> pa.Array:
    """ASCII-lower-cased words joined by single spaces; null texts become empty."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    return pc.utf8_trim(pc.binary_join(split, " "), " ")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp (the 64 bits as a bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [fingerprint(s.encode(), shingle) for s in normal_words(b.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _block_masks(blocks: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _pivots(n: int) -> list[int]:
    r = random.Random(SEED)
    return [r.getrandbits(BITS) for _ in range(n)]


def distance(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(F.lit(_signed(b)) if isinstance(b, int) else b))


def pivot_table(fps: DataFrame, blocks: int, *keep: str, families: int = FAMILIES) -> DataFrame:
    """fp, columns of ``keep``, plain (distances to the pivots that discard), near (by block, the distances inside it packed into one number)."""
    pivots = _pivots(max(PLAIN, families))
    x = F.col("fp")
    near = []
    for mask in _block_masks(blocks):
        packed = F.lit(0).cast("bigint")
        for p in pivots[:families]:
            less = distance(x, p) - distance(x, p ^ mask)  # twice the distance inside the block, less its width
            packed = packed * 65 + F.shiftright(less + mask.bit_count(), 1)
        near.append(packed)
    plain = F.lit(0).cast("bigint")  # seven bits a distance
    for p in pivots[:PLAIN]:
        plain = F.shiftleft(plain, 7).bitwiseOR(distance(x, p))
    return fps.select("fp", *keep, plain.alias("plain"), F.array(*near).alias("near"))


def _pairs(cells: DataFrame, keys: list[str], max_distance: int, blocks: int = 0) -> DataFrame:
    """Linked pairs within cells; the join emits survivors of the pivots only, and with ``blocks`` each pair in its first cell only."""
    a, b = cells.alias("a"), cells.alias("b")
    on = F.col("a.fp") < F.col("b.fp")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    for i in range(PLAIN):
        at = lambda side: F.shiftright(F.col(f"{side}.plain"), 7 * i).bitwiseAND(F.lit(127))  # noqa: E731, B023
        on = on & (F.abs(at("a") - at("b")) <= max_distance)
    on = on & (distance(F.col("a.fp"), F.col("b.fp")) <= max_distance)
    if blocks:
        x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
        combos = list(combinations(range(blocks), blocks - max_distance))
        masks = _block_masks(blocks)
        # a combination is the pair's first if its blocks agree and each block before its last that isn't in it differs
        rules = F.array(*(F.array(*(F.lit(_signed(masks[j])) for j in range(c[-1]) if j not in c)).cast("array<bigint>") for c in combos))
        on = on & F.forall(F.element_at(rules, F.col("a.combo") + 1), lambda m: x.bitwiseAND(m) != 0)
    return a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def links(fps: DataFrame, scratch: Scratch, max_distance: int, blocks: int, crowd: int | None) -> DataFrame:
    """(a, b): linked pairs of the distinct fingerprints ``fps``; without ``crowd`` no cell is taken apart."""
    combos = list(combinations(range(blocks), blocks - max_distance))
    table = pivot_table(fps, blocks)
    cell = F.explode(F.array(*(F.struct(F.lit(i).alias("combo"), F.xxhash64(*(F.col("near")[j] for j in c)).alias("cell")) for i, c in enumerate(combos))))
    cells = scratch.save(table.select("fp", "plain", cell.alias("x")).select("fp", "plain", "x.combo", "x.cell"), "cells")
    sizes = scratch.save(cells.groupBy("combo", "cell").count().where("count > 1"), "sizes")
    shared = cells.join(sizes, ["combo", "cell"])
    few = (shared if crowd is None else shared.where(F.col("count") <= crowd)).select("combo", "cell", "fp", "plain")
    found = _pairs(few, ["combo", "cell"], max_distance, blocks)
    if crowd is None:
        return scratch.save(found, "links")

    masks = _block_masks(blocks)
    finer = []
    for i, c in enumerate(combos):
        rest = [p for p in range(BITS) if not any(masks[j] >> p & 1 for j in c)]
        slivers = [sum(1 << p for p in rest[k : k + SLIVER]) for k in range(0, len(rest), SLIVER)]
        keys = []
        for out in combinations(range(len(slivers)), min(max_distance, len(slivers))):
            keep = sum(s for k, s in enumerate(slivers) if k not in out) | sum(masks[j] for j in c)
            keys.append(keep)
        finer.append(keys)
    # bitwise keys: what a combination's fingerprints share besides the cell
    many = shared.where(F.col("count") > crowd).select("combo", "fp", "plain")
    keyed = None
    if sizes.where(F.col("count") > crowd).limit(1).count():
        for i, keys in enumerate(finer):
            part = many.where(F.col("combo") == i)
            key = F.explode(F.transform(F.array(*(F.lit(_signed(k)) for k in keys)), lambda m: F.struct(m.alias("mask"), F.col("fp").bitwiseAND(m).alias("bits"))))
            part = part.select("fp", "plain", key.alias("k")).select("fp", "plain", F.lit(i).alias("combo"), "k.mask", "k.bits")
            keyed = part if keyed is None else keyed.unionByName(part)
        full = scratch.save(keyed, "slivers")
        # fingerprints that share all but ``max_distance`` slivers: pairs among at most 2 ** (SLIVER * max_distance)
        found = found.unionByName(_pairs(full, ["combo", "mask", "bits"], max_distance))
    return scratch.save(found.distinct(), "links")


def near_copies(docs: DataFrame, shingle: int = 5, max_distance: int = 2, blocks: int = 3, crowd: int | None = 256) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, shingle), "fps")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), scratch, max_distance, blocks, crowd), scratch)
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = labelled.join(lowest, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


#: Near-copies as a stage: texts whose five-word shingles have a Jaccard similarity of 0.8 or more link.
WIDE, SHINGLE = 256, 5
#: Fingerprints of a text, and shingles in the sample of each: a pair at 0.8 has no sample in common with a chance of (1 - 0.8 ** 4) ** 32, 5 in 100 million.
SAMPLES, SAMPLE = 32, 4
#: Such fingerprints link at so many bits, by cells of one of two blocks; ten families tell blocks of 32 bits apart.
SAMPLE_DISTANCE, SAMPLE_BLOCKS, SAMPLE_FAMILIES = 1, 2, 10
#: And candidates differ in at most 72 of 256 bits: at 0.8 they differ in 40, give or take 6, so beyond 72 with a chance of 1 in 100 million.
CANDIDATE_BITS = 72
#: Shingles whose minima are sought at once: 2 MB.
AT_ONCE = 2048


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last steps of splitmix64: every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SALTS = _mixed(np.arange(1, SAMPLES * SAMPLE + WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = _SALTS[: SAMPLES * SAMPLE] | np.uint64(1)
_INVERSE = np.array([pow(int(x), -1, 1 << 64) for x in _ODD], dtype=np.uint64)


def shingle_set(normal: bytes) -> np.ndarray:
    """64-bit hashes of the distinct five-word shingles, sorted; a shorter text is one shingle."""
    w = normal.split(b" ")
    shingles = set(zip(*(w[i:] for i in range(SHINGLE))))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    found = [digest(join(x), SEED) for x in shingles] or [digest(normal, SEED)]
    return np.unique(np.array(found, dtype=np.uint64))


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of all shingles (256 bits, four bigints), and of ``SAMPLES`` samples (64 bits each).

    A sample is the shingles that come first in ``SAMPLE`` orders, the same for
    all texts, so texts share it with a chance of their similarity for each.
    """
    n = len(shingles)
    ones = np.zeros(WIDE, dtype=np.int64)
    least = np.full(SAMPLES * SAMPLE, 2**64 - 1, dtype=np.uint64)
    for at in range(0, n, AT_ONCE):
        part = shingles[at : at + AT_ONCE]
        lanes = _mixed(part[:, None] ^ _SALTS[SAMPLES * SAMPLE :])
        ones += np.unpackbits(lanes.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (part * _ODD[:, None]).min(axis=1))
    sampled = np.unpackbits((least * _INVERSE).view(np.uint8).reshape(SAMPLES, SAMPLE, 8), axis=2).sum(axis=1, dtype=np.int64)
    return np.packbits(ones * 2 > n).view(np.int64), np.packbits(sampled * 2 > SAMPLE, axis=1).view(np.int64).ravel()


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, copy (128 bits of the words), wide (four bigints), fps (bigints, one for each sample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [s.encode() for s in normal_words(b.column("text")).to_pylist()]
            pairs = [sketch(shingle_set(t)) for t in texts]
            columns = [b.column("doc_id"), pa.array([xxhash.xxh3_128_hexdigest(t) for t in texts], pa.string())]
            for k, size in enumerate((WIDE // 64, SAMPLES)):
                flat = np.concatenate([x[k] for x in pairs]) if pairs else np.zeros(0, dtype=np.int64)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * size), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "wide", "fps"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, copy string, wide array<bigint>, fps array<bigint>")


def _forest(found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of links between rows enough to keep the same groups."""
    root: dict[int, int] = {}
    out = []
    for i, j in found:
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = a, b
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            while root.setdefault(y, y) != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[x] = y
                out.append((a, b))
    return out


#: Runs of more rows than this are searched from one row to the next that it reaches.
LONG_RUN = 256


def cell_links(cell: np.ndarray, fp: np.ndarray, wide: np.ndarray, max_distance: int, similar: int) -> list[tuple[int, int]]:
    """Row pairs that link, within runs of equal ``cell``, as a forest: as many pairs as it takes to connect what is linked.

    In a long run each row is compared with those that nothing has reached yet,
    so a large group of near copies costs little more than one look at each.
    """
    table = np.stack([np.bitwise_count(fp.view(np.uint64) ^ np.uint64(p)) for p in _pivots(PLAIN)], axis=1).astype(np.int16)

    def near(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        ok = (np.abs(table[i] - table[j]) <= max_distance).all(axis=1)  # pivots
        ok &= np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= max_distance
        return ok & (np.bitwise_count((wide[i] ^ wide[j]).view(np.uint64)).sum(axis=1) <= similar)

    found = []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
    long = np.diff(cuts) > LONG_RUN
    for a, z in zip(cuts[:-1][long], cuts[1:][long]):
        rest = np.arange(a, z)
        while len(rest):
            todo, rest = [int(rest[0])], rest[1:]
            while todo and len(rest):
                x = todo.pop()
                hit = near(x, rest)
                if hit.any():
                    reached, rest = rest[hit], rest[~hit]
                    found.append((np.full(len(reached), x), reached))
                    todo += reached.tolist()
    row, k = np.flatnonzero(~np.repeat(long, np.diff(cuts))), 1
    while True:
        row = row[row + k < len(cell)]
        row = row[cell[row] == cell[row + k]]  # runs shorter than k are through
        if not len(row):
            return _forest(found)
        linked = row[near(row, row + k)]
        if len(linked):
            found.append((linked, linked + k))
        k += 1


def forest_links(texts: DataFrame, max_distance: int, blocks: int, similar: int, families: int = FAMILIES) -> DataFrame:
    """(a, b): nodes of ``texts`` (node, fp, wide) whose links connect what is linked.

    Every cell gives a forest instead of all pairs of a group of near copies;
    each link lies in some cell, so all forests together have its groups.  A
    node may have several fingerprints, a row for each.
    """
    combos = list(combinations(range(blocks), blocks - max_distance))
    table = pivot_table(texts, blocks, "node", "wide", families=families)
    cells = F.array(*(F.xxhash64(F.lit(i), *(F.col("near")[j] for j in c)) for i, c in enumerate(combos)))
    rows = table.select("node", "fp", "wide", F.explode(cells).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cell, node, fp, *wide = (np.concatenate(c) for c in zip(*held))
            held.clear()
            links_ = cell_links(cell, fp, np.stack(wide, axis=1), max_distance, similar)
            a, b = (np.array(x, dtype=np.int64) for x in (zip(*links_) if links_ else ((), ())))
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        for b in batches:
            part = [b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "node", "fp")]
            lanes = b.column("wide").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDE // 64)
            part += [lanes[:, k] for k in range(lanes.shape[1])]
            if not len(part[0]):
                continue
            if held and sum(len(h[0]) for h in held) >= 20_000 and held[-1][0][-1] != part[0][0]:
                yield flush()
            elif held and held[-1][0][-1] == part[0][0] and part[0][-1] != part[0][0]:
                end = int(np.searchsorted(part[0] != part[0][0], True))  # the run that goes on ends here
                held.append([x[:end] for x in part])
                part = [x[end:] for x in part]
                yield flush()
            held.append(part)
        if held:
            yield flush()

    dealt = rows.repartition("cell").sortWithinPartitions("cell", "node").select("cell", "node", "fp", "wide")
    return dealt.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def sample_links(texts: DataFrame) -> DataFrame:
    """(a, b): nodes of ``texts`` (node, wide, fps) whose links connect all candidates."""
    each = texts.select("node", "wide", F.explode(F.array_distinct("fps")).alias("fp"))
    return forest_links(each, SAMPLE_DISTANCE, SAMPLE_BLOCKS, CANDIDATE_BITS, SAMPLE_FAMILIES)


def exact_groups(sets: list[np.ndarray]) -> np.ndarray:
    """By set, the first set of its group; sets link if they share 0.8 of their union."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(size)])
    group, mark = np.full(len(sets), -1), np.zeros(int(ids.max()) + 1, dtype=bool)
    rest, flat = np.arange(len(sets)), ids
    for i in range(len(sets)):
        if group[i] >= 0:
            continue
        group[i], todo = i, [i]
        while todo:
            x = todo.pop()
            if 2 * (group[rest] < 0).sum() < len(rest):  # sets that have a group are left out of the search
                rest = rest[group[rest] < 0]
                flat = np.concatenate([ids[begin[k] : begin[k + 1]] for k in rest]) if len(rest) else ids[:0]
            if not len(rest):
                break
            own = ids[begin[x] : begin[x + 1]]
            mark[own] = True
            shared = np.add.reduceat(mark[flat], np.concatenate([[0], np.cumsum(size[rest])[:-1]]), dtype=np.int64)
            mark[own] = False
            found = rest[(9 * shared >= 4 * (size[rest] + size[x])) & (group[rest] < 0)]  # shared / union >= 4 / 5
            group[found] = i
            todo += found.tolist()
    return group


#: Sets that a task compares with each other are two blocks of so many.
BLOCK = 256


def verified(docs: DataFrame, texts: DataFrame, groups: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """node, root: ``groups`` (node, root) of candidates taken apart by the exact similarity of their shingles.

    Every member is compared with its group's hub, in a join; those that link to
    it are through.  The others are compared with all members of their group,
    block by block, so no group, however large, need fit into a task, and only
    members that the hub doesn't reach cost more than one comparison.
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words_ = [s.encode() for s in normal_words(b.column("text")).to_pylist()]
            sets = pa.array([shingle_set(t).view(np.int64) for t in words_], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_hexdigest(t) for t in words_], pa.string()), sets], ["copy", "shingles"])

    def compared(pair: pa.Table) -> pa.Table:
        nodes = pair.column("node").to_numpy()
        order = np.argsort(nodes)
        sets = [x.values.to_numpy() for x in pair.column("shingles")]
        first = nodes[order][exact_groups([sets[k] for k in order])]
        link = nodes[order] != first
        return pa.table({"a": nodes[order][link], "b": first[link]})

    members = texts.join(groups, "node").select("copy", "node", "root", F.coalesce(F.col("first.doc_id").cast("string"), F.lit("\x00")).alias("id"))
    asked = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")).alias("id"), "text").join(members.select("id").distinct(), "id", "left_semi")
    sets = asked.select("text").mapInArrow(shingled, "copy string, shingles array<bigint>").dropDuplicates(["copy"])
    sets = scratch.save(sets.join(members, "copy").select("node", "root", "shingles"), "sets", 16 * groups.count())  # 4 KB a row or so
    hubs = sets.groupBy("root").agg(F.min("node").alias("hub"), F.min_by("shingles", "node").alias("of_hub"))
    # shared / union >= 4 / 5; a hot root is a skewed join of few rows with many, which adaptive execution splits
    links_ = 9 * F.size(F.array_intersect("shingles", "of_hub")) >= 4 * (F.size("shingles") + F.size("of_hub"))
    hubbed = scratch.save(sets.join(hubs, "root").select("node", "root", "hub", links_.alias("linked")), "hubbed")
    blocks = lambda c: F.ceil(F.sum(c.cast("int")) / block).cast("int")
    open_ = hubbed.groupBy("root").agg(blocks(~F.col("linked")).alias("nl"), blocks(F.col("linked")).alias("nk")).where("nl > 0")
    rows = hubbed.select("node", "root", "linked").join(open_, "root")
    own = F.when(F.col("linked"), F.col("nl") + F.pmod(F.xxhash64("node"), "nk")).otherwise(F.pmod(F.xxhash64("node"), "nl")).cast("int")
    last = F.when(F.col("linked"), F.col("nl") - 1).otherwise(F.col("nl") + F.col("nk") - 1)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    pairs = rows.select("node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sets.select("node", "shingles"), "node")
    more = pairs.groupBy("root", "i", "j").applyInArrow(compared, "a bigint, b bigint")
    direct = hubbed.where("linked and node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return components(scratch.save(direct.unionByName(more).distinct(), "exact", groups.count()), scratch, "cx")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest doc_id; all columns stay.

    Texts of equal words are copies.  Distinct texts link if their sets of
    five-word shingles have a Jaccard similarity of 0.8 or more.  At 0.8 one
    fingerprint of the whole text differs in 10 of 64 bits, which is too far for
    cells that lose no link.  So a text has a fingerprint of each of 32 samples
    of its shingles, which is equal where the sample is.  The pivot tables find
    all fingerprints that differ in at most one bit; those whose texts' 256-bit
    fingerprints are near as well are candidates.  Groups of candidates are then
    taken apart by the exact similarity of all their pairs.  Texts without words
    are copies of each other.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.save(profiles(docs), "profiles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    texts = rows.groupBy("copy").agg(first, F.first("wide").alias("wide"), F.first("fps").alias("fps")).withColumn("node", F.xxhash64("copy"))
    texts = scratch.save(texts, "texts", n := rows.count())
    near = scratch.save(components(scratch.save(sample_links(texts), "candidates", n), scratch), "near", n)
    roots = scratch.save(verified(docs, texts, near, scratch), "verified", n).withColumnRenamed("node", "k")
    labelled = texts.join(roots, texts["node"] == roots["k"], "left").select("copy", "first", F.coalesce("root", "node").alias("root"))
    stays = labelled.groupBy("root").agg(F.min_by(F.struct("copy", "first"), F.struct("first", "copy")).alias("s"))
    stays = scratch.save(stays.select(F.col("s.copy").alias("__q_copy"), F.coalesce(F.col("s.first.doc_id").cast("string"), F.lit("\x00")).alias("__q_id")), "stays", n)
    # rows of that id; where ids repeat, one row of that id and those words
    keyed = docs.withColumn("__q_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")))
    if not rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return keyed.join(stays, "__q_id", "left_semi").select(*docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            marks = [xxhash.xxh3_128_hexdigest(s.encode()) for s in normal_words(b.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.string())], [*b.schema.names, "__q_copy"])

    marked = keyed.mapInArrow(run, StructType([*keyed.schema.fields, StructField("__q_copy", StringType())]))
    whole = F.struct(*docs.columns)
    one = marked.join(stays, ["__q_id", "__q_copy"], "left_semi").groupBy("__q_id", "__q_copy").agg(F.min_by(whole, F.to_json(whole)).alias("_row"))
    return one.select("_row.*")


def op6(docs: DataFrame) -> DataFrame:
    found = near_copies(docs, shingle=3, max_distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
