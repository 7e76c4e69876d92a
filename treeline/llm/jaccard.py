"""Exact Jaccard components over word shingles by PartEnum signatures.

Similar sets differ in few elements: |r - s| + |s - r| <= (|r| + |s|) (1 - t) / (1 + t). Sizes fall into bands; a
set takes part in its own band and, if it is close enough to the next, there too, so similar sets share a
band with a common bound k. Within a band the element domain is cut by hash into partitions, and signatures
are hashes of a set's part in subsets of them:

* k small: k + 2 partitions; k differences leave two untouched, so every pair of partitions is a signature.
* k large: first-level partitions of two halves each, k + 1 + slack halves in all; each half is a
  signature. Halves that are empty are left out as long as a set has no more of them than slack,
  since then a non-empty untouched one remains.

Elements found in a large share of a bounded sample of documents are left out of the partitioned domain; the
bound holds on what remains, so this loses nothing and keeps common passages out of the buckets.

Equal sets are one node (64-bit fingerprint of a set of 64-bit shingle hashes). A bucket's centre is its smallest
node, and the buckets of one centre are one group: nodes that share a signature share a group, and a node is in a
group once, however many signatures led it there. Each node is first checked against the centre it shares most
signatures with. Then, in rounds, while a group holds several components, nodes meet the most alike nodes of other
components there: sizes and sketches bound the true difference of two sets from below, and sets are fetched
only for pairs these bounds allow. Sketches grow with the sets, so few unlinked pairs get that far. The last round
takes every pair that the bounds leave between components, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import Workspace, id_text, slices, tidy
from treeline.llm.components import components

RATIO = 1.35
#: Largest k of the two-of-k+2 scheme.
SMALL_K = 8
#: Cells of the sketch that goes with a group member: half its set's size or more, as a power of two within these bounds.
NARROW, WIDE = 64, 1024
#: Pairs whose sketches are compared at once, and rows of whole groups taken together.
STEP, ROWS = 1 << 17, 8192
#: Common elements: in this share of a sample of so many documents (smallest by hash of the id).
COMMON_SHARE, COMMON_SAMPLE = 0.05, 2000
#: Hot signatures: those of so many nodes in a sample (smallest by hash of the id); a list of a bounded size.
HOT_SAMPLE, HOT_NODES = 2000, 20
#: Nodes a task checks against one centre, about.
GROUP = 128
#: Nodes of a group that a task compares with as many others, about.
BLOCK = 1024
#: Partners per node tried in each round; the last number means all.
QUOTAS = (1, 8, 1 << 30)
#: Representative ids up to which they are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
SEEN = 1_000_000

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64((salt * int(_P)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, element) of all texts' sets, sorted. Words are what ASCII white space divides, with A-Z
    in lower case; a text of fewer words is one element."""
    from xxhash import xxh3_64_intdigest

    split = [t.encode("utf-8").lower().split() for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    total = int(lengths.sum())
    w = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, total)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(split)), lengths)
    h = np.zeros(total, np.uint64)
    for i in range(words):
        part = np.zeros(total, np.uint64)
        part[: max(0, total - i)] = w[i:]
        h = _mix(h * _P + part)
    whole = np.arange(total) + words <= ends[doc]
    doc, h = doc[whole], h[whole]
    short = np.flatnonzero((lengths > 0) & (lengths < words))
    if len(short):
        one = np.zeros(len(short), np.uint64)
        for k, d in enumerate(short):
            x = np.uint64(lengths[d])
            for i in range(int(ends[d] - lengths[d]), int(ends[d])):
                x = _mix(np.array([x * _P + w[i]], np.uint64), 1)[0]
            one[k] = x
        doc, h = np.r_[doc, short], np.r_[h, one]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def fingerprints(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, fingerprint) per document."""
    size = np.bincount(doc, minlength=n)
    total = np.zeros(n, np.uint64)
    np.add.at(total, doc, _mix(h, 3))
    return size, _mix(total + size.astype(np.uint64) * _P, 4).view(np.int64)


@lru_cache
def bands(num: int, den: int, largest: int = 1 << 40) -> np.ndarray:
    """First size of every band."""
    out = [1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, int(out[-1] * max(RATIO, den / num))))
    return np.array(out)


def difference(a, b, num: int, den: int):
    """Most elements in which sets of these sizes may differ."""
    return (a + b) * (den - num) // (den + num)


def signatures(doc: np.ndarray, h: np.ndarray, size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature); h without the common elements, size with them."""
    first = bands(num, den)
    own = np.searchsorted(first, size, side="right") - 1
    docs_out, sigs_out = [], []
    value, place = _mix(h, 5), _mix(h, 6)
    for up in (0, 1):
        band = own + up
        takes = size > 0
        if up:
            takes &= size * den // num >= first[band]
        k = difference(first[band + 1] - 1, first[band + 1] - 1, num, den)
        takes &= k > 0
        if not takes.any():
            continue
        slack = k // 8 + 1
        parts = np.where(k <= SMALL_K, k + 2, 2 * (-(-(k + 1 + slack) // 2)))
        at = np.cumsum(np.where(takes, parts, 0)) - np.where(takes, parts, 0)
        cells = int(np.where(takes, parts, 0).sum())
        live = takes[doc]
        cell = at[doc[live]] + (place[live] % parts[doc[live]].astype(np.uint64)).astype(np.int64)
        total = np.zeros(cells, np.uint64)
        np.add.at(total, cell, value[live])
        many = np.bincount(cell, minlength=cells)
        owner = np.repeat(np.flatnonzero(takes), parts[takes])
        index = np.arange(cells) - at[owner]
        total = _mix(total + many.astype(np.uint64), 7)
        tag = _mix(band.astype(np.uint64), 8)
        large = (k > SMALL_K)[owner]
        empties = np.bincount(owner, many == 0, minlength=len(size))
        keep = large & ((many > 0) | (empties > slack)[owner])
        docs_out.append(owner[keep])
        sigs_out.append(_mix(total[keep] + tag[owner[keep]] + index[keep].astype(np.uint64) * _P, 9))
        for kk in range(1, SMALL_K + 1):  # pairs of partitions, for all documents with this k at once
            d = np.flatnonzero(takes & (k == kk))
            if len(d):
                t = total[at[d][:, None] + np.arange(kk + 2)]
                for i in range(kk + 2):
                    for j in range(i + 1, kk + 2):
                        docs_out.append(d)
                        sigs_out.append(_mix(t[:, i] * _P + t[:, j] + tag[d], 16 * i + j + 32))
    if not docs_out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(docs_out), np.concatenate(sigs_out).view(np.int64)


def sketches(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Saturated element counts per hash cell, all documents' in one array, and where each one's begin. Their
    distance never exceeds the sets' difference; a width divides the next, so wider ones fold into narrower."""
    width = np.clip(1 << np.ceil(np.log2(np.maximum(size, 2) / 2)).astype(np.int64), NARROW, WIDE) * (size > 0)
    at = np.r_[0, np.cumsum(width)]
    cell = at[doc] + (_mix(h, 10) % np.maximum(width, 1).astype(np.uint64)[doc]).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=at[-1]), 255).astype(np.uint8), at


def folded(cells: np.ndarray, at: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The sketches of rows as a matrix of this width, which theirs reach."""
    out = np.zeros((len(rows), width), np.int16)
    wide = at[rows + 1] - at[rows]
    for w in np.unique(wide):
        some = np.flatnonzero(wide == w)
        out[some] = cells[at[rows[some]][:, None] + np.arange(w)].reshape(len(some), w // width, width).sum(1)
    return out


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """Elements common in the bounded sample. Any choice is right, as long as all documents share it."""
    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(COMMON_SAMPLE).distinct()
    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [shingle_sets(p.column("text").to_pylist(), words)[1] for b in batches for p in slices(b)]
        e, n = np.unique(np.concatenate(parts or [np.empty(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(n)], names=["e", "n"])

    least = max(20, int(COMMON_SHARE * COMMON_SAMPLE))
    found = rows.mapInArrow(tidy(run), "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["e"] for r in found.select("e").collect()], np.int64).view(np.uint64))  # 1/share times a set at most


def _signed(docs: DataFrame, words: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """(doc_id, n, fp, sigs, sketch) per row; the last two only for the first of equal sets that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                doc, h = shingle_sets(texts, words)
                size, fp = fingerprints(doc, h, len(texts))
                fresh = np.zeros(len(texts), bool)
                known = part.column("doc_id").is_valid().to_pylist()
                for i, f in enumerate(fp.tolist()):
                    if size[i] and known[i] and f not in seen:
                        fresh[i] = True
                        seen.add(f)
                if len(seen) > SEEN:
                    seen.clear()
                keep = fresh[doc]
                cells, at = sketches(doc[keep], h[keep], np.where(fresh, size, 0))
                sketch = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(cells)])
                if len(common):
                    spot = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    keep &= common[spot] != h
                d, s = signatures(doc[keep], h[keep], np.where(fresh, size, 0), num, den)
                order = np.argsort(d, kind="stable")
                offsets = np.r_[0, np.cumsum(np.bincount(d, minlength=len(texts)))].astype(np.int32)
                sigs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(s[order]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(fp), sigs, sketch],
                    names=["doc_id", "n", "fp", "sigs", "sketch"],
                )

    return docs.mapInArrow(tidy(run), "doc_id long, n long, fp long, sigs array<long>, sketch binary")


def _sets(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """(fp, elements) of the representative documents (doc_id)."""
    ids = reps.select("doc_id").distinct()
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                doc, h = shingle_sets(texts, words)
                size, fp = fingerprints(doc, h, len(texts))
                ends = np.r_[0, np.cumsum(size)]
                elements = pa.array([h[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(fp), elements], names=["fp", "elements"])

    return rows.mapInArrow(tidy(run), "fp long, elements binary")


def _linked(a: bytes, b: bytes, num: int, den: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _star(stars: DataFrame, sets: DataFrame, num: int, den: int, work: Workspace) -> DataFrame:
    """Check members (fp) against their centre: (fp, centre, linked)."""
    many = stars.groupBy("centre").agg(F.count("*").alias("many"))
    salts = F.ceil(F.col("many") / GROUP).cast("int")
    members = stars.join(many, "centre").select("fp", "centre", F.pmod(F.xxhash64("fp"), salts).cast("int").alias("salt"), F.lit(1).alias("role"))
    heads = many.select(F.col("centre").alias("fp"), "centre", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("role"))
    roles = work.table(members.unionByName(heads), "roles")
    small = roles.count() <= BROADCAST_IDS
    rows = sets.join(F.broadcast(roles) if small else roles, "fp")
    rows = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, b""
        for b in batches:
            out = []
            for fp, elements, centre, salt, role in zip(*(b.column(c).to_pylist() for c in ("fp", "elements", "centre", "salt", "role"))):
                if role == 0:
                    key, head = (centre, salt), elements
                else:
                    assert key == (centre, salt)
                    out.append((fp, centre, _linked(head, elements, num, den)))
            cols = list(zip(*out)) or [[]] * 3
            kinds = (pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["fp", "centre", "linked"])

    return rows.select("fp", "elements", "centre", "salt", "role").mapInArrow(tidy(run), "fp long, centre long, linked boolean")


def _shared(nodes: DataFrame) -> DataFrame:
    """(fp, centre, votes): how many signatures a node shares with each bucket's centre, its smallest node. A window
    finds it, and for signatures that are hot in the sample, a broadcast minimum: no task takes a large share of all
    nodes. The sample decides how rows are dealt, never what results."""
    sig = F.explode("sigs").alias("sig")
    sample = nodes.where(F.size("sigs") > 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(HOT_SAMPLE).dropDuplicates(["fp"])
    hot = sample.select(sig).groupBy("sig").count().where(F.col("count") >= HOT_NODES).select("sig")
    hot = [r["sig"] for r in hot.collect()]  # signatures of a set * HOT_SAMPLE / HOT_NODES at most
    buckets = nodes.select("fp", sig)
    centre = F.first("fp").over(Window.partitionBy("sig").orderBy("fp").rowsBetween(Window.unboundedPreceding, 0))
    if hot:
        listed = F.broadcast(nodes.sparkSession.createDataFrame([(x,) for x in hot], "sig long"))
        those = buckets.join(listed, "sig", "left_semi")
        least = those.groupBy("sig").agg(F.min("fp").alias("centre"))
        met = buckets.join(listed, "sig", "left_anti").withColumn("centre", centre)
        met = met.select("fp", "centre").unionByName(those.join(F.broadcast(least), "sig").select("fp", "centre"))
    else:
        met = buckets.withColumn("centre", centre)
    return met.where("fp <> centre").groupBy("fp", "centre").agg(F.count("*").alias("votes"))


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by keys, some ROWS at a time but never a group divided, with the places where groups begin."""

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    held: list[pa.Table] = []
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        if sum(t.num_rows for t in held) >= ROWS:
            t = pa.concat_tables(held)
            at = begins(t)
            if len(at) > 1:
                yield t.slice(0, at[-1]), at[:-1]
                t = t.slice(at[-1])
            held = [t]
    if held and (t := pa.concat_tables(held)).num_rows:
        yield t, begins(t)


def _best(rows: tuple[np.ndarray, np.ndarray, np.ndarray], quota: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (left, right, distance) those among the quota nearest of either side."""
    left, right, d = rows
    if quota >= len(d):
        return rows
    node, pair = np.r_[left, right], np.tile(np.arange(len(d)), 2)
    order = np.lexsort((d[pair], node))
    node, pair = node[order], pair[order]
    first = np.r_[True, node[1:] != node[:-1]]
    rank = np.arange(len(node)) - np.maximum.accumulate(np.where(first, np.arange(len(node)), 0))
    keep = np.unique(pair[rank < quota])
    return left[keep], right[keep], d[keep]


def allowed(t: pa.Table, at: np.ndarray, quota: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, distance) of rows of one group that sizes and sketches allow to be linked, of unlike labels."""
    side, same, label, n = (t.column(c).to_numpy() for c in ("side", "same", "label", "n"))
    sketch = t.column("sketch").combine_chunks()
    cells = np.frombuffer(b"".join(sketch.to_pylist()), np.uint8)
    begin = np.r_[0, np.cumsum(np.array(pa.compute.binary_length(sketch), np.int64))]
    narrow = folded(cells, begin, np.arange(len(n)), NARROW)
    group = np.searchsorted(at, np.arange(len(n)), side="right") - 1
    end = np.r_[at[1:], len(n)][group]
    right_from = end - np.bincount(group, side, minlength=len(at)).astype(np.int64)[group]
    low = np.where(same, np.arange(len(n)) + 1, np.where(side == 0, right_from, end))
    many = end - low
    total = np.r_[0, np.cumsum(many)]
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for start in range(0, int(total[-1]), STEP):
        nth = np.arange(start, min(start + STEP, int(total[-1])))
        left = np.searchsorted(total, nth, side="right") - 1
        right = low[left] + nth - total[left]
        keep = (label[left] != label[right]) & (den * np.minimum(n[left], n[right]) >= num * np.maximum(n[left], n[right]))
        left, right = left[keep], right[keep]
        most = difference(n[left], n[right], num, den)
        keep = np.abs(narrow[left] - narrow[right]).sum(1, dtype=np.int64) <= most
        left, right, most = left[keep], right[keep], most[keep]
        d = np.zeros(len(left))
        width = np.minimum(np.diff(begin)[left], np.diff(begin)[right])
        for w in np.unique(width):
            some = np.flatnonzero(width == w)
            rows, place = np.unique(np.r_[left[some], right[some]], return_inverse=True)
            wide = folded(cells, begin, rows, int(w))
            for i in range(0, len(some), 4096):
                x, y = place[: len(some)][i : i + 4096], place[len(some) :][i : i + 4096]
                d[some[i : i + 4096]] = np.abs(wide[x] - wide[y]).sum(1, dtype=np.int64)
        keep = d <= most
        out.append(_best((left[keep], right[keep], d[keep] / (n[left] + n[right])[keep]), quota))
    return _best(tuple(np.concatenate(c) for c in zip(*out)), quota)


def _alike(members: DataFrame, quota: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of unlike components within a group that the bounds allow, quota per node and group.
    members: (centre, fp, label, n, sketch); large groups are dealt as pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _whole(batches, ["centre", "x", "y"]):
            left, right, _ = allowed(t, at, quota, num, den)
            fp = t.column("fp").to_numpy()
            pairs = np.unique(np.sort(np.stack([fp[left], fp[right]], 1), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    many = members.groupBy("centre").agg(F.count("*").alias("many"))
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    rows = members.join(many, "centre").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(9)), F.col("blocks")).cast("int"))
    # Block i meets every block j >= i: as the left side of (i, j), as the right side of (j, i) otherwise.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("centre", "fp", "label", "n", "sketch", "mine", other)
    x, y, side = F.least("mine", "other"), F.greatest("mine", "other"), (F.col("mine") > F.col("other")).cast("int")
    rows = rows.select("centre", x.alias("x"), y.alias("y"), side.alias("side"), (x == y).alias("same"), "fp", "label", "n", "sketch")
    rows = rows.repartition("centre", "x", "y").sortWithinPartitions("centre", "x", "y", "side")
    return rows.mapInArrow(tidy(run), "a long, b long").distinct()


def _pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The linked ones of pairs (a, b)."""
    x = sets.select(F.col("fp").alias("a"), F.col("elements").alias("ea"))
    y = sets.select(F.col("fp").alias("b"), F.col("elements").alias("eb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_linked(p, q, num, den) for p, q in zip(b.column("ea").to_pylist(), b.column("eb").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "ea", "eb").mapInArrow(tidy(run), "a long, b long")


def join(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs: sets link when den * |both| >= num * |either|;
    component_id is the smallest doc_id reachable by links.

    Null and empty texts and texts without words have an empty set, link with nothing and are their own
    component. Repeated rows and equal texts are linked. A null id has component null and takes no part; an empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    texts = id_text(docs)
    signed = work.table(_signed(texts, words, num, den, _common(texts, words)), "signed")
    linkable = signed.where("n > 0 and doc_id is not null")
    shared = work.table(_shared(linkable.select("doc_id", "fp", "sigs")), "shared")
    nodes = work.table(shared.select("fp").unionByName(shared.select(F.col("centre").alias("fp"))).distinct(), "nodes")
    info = signed.where(F.length("sketch") > 0).join(nodes, "fp", "left_semi").groupBy("fp")
    info = work.table(info.agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "info")
    signed = work.table(signed.select("doc_id", "n", "fp"), "rows")
    work.forget("signed")
    linkable = signed.where("n > 0 and doc_id is not null")
    # Each node's first check: the centre it shares most buckets with.
    stars = shared.groupBy("fp").agg(F.max(F.struct("votes", "centre"))["centre"].alias("centre"))
    stars = work.table(stars, "stars")
    reps = work.table(linkable.join(nodes, "fp").groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "reps")
    sets = _sets(texts, reps, words)
    if not stars.isEmpty():
        checked = work.table(_star(stars, sets, num, den, work), "checked")
        links = checked.where("linked").select(F.col("centre").alias("a"), F.col("fp").alias("b"))
        tried = checked.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b")).distinct()
        labels = components(links, work, "c0")
        for turn, quota in enumerate(QUOTAS):
            fp_label = labels.select(F.col("node").alias("fp"), "label")
            known = shared.select("centre", "fp").join(fp_label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
            centres = fp_label.select(F.col("fp").alias("centre"), F.col("label").alias("of_centre"))
            known = known.join(centres, "centre", "left").withColumn("of_centre", F.coalesce("of_centre", "centre"))
            split = known.where("label <> of_centre").select("centre").distinct()
            # Components only grow, so other groups never matter again.
            shared = work.table(known.join(split, "centre", "left_semi"), f"mixed-{turn}")
            heads = shared.select("centre", F.col("centre").alias("fp"), F.col("of_centre").alias("label")).distinct()
            members = shared.select("centre", "fp", "label").unionByName(heads)
            members = work.table(members.join(info, "fp"), f"members-{turn}")
            if members.isEmpty():
                break
            fresh = _alike(members, quota, num, den).join(tried, ["a", "b"], "left_anti")
            fresh = work.table(fresh.select("a", "b"), f"pairs-{turn}")
            if fresh.isEmpty():
                continue
            wanted = fresh.select(F.col("a").alias("fp")).unionByName(fresh.select(F.col("b").alias("fp"))).distinct()
            some = work.table(_sets(texts, reps.join(wanted, "fp", "left_semi"), words), f"sets-{turn}")
            if some.count() > some.select("fp").distinct().count():  # repeated ids
                some = work.table(some.dropDuplicates(["fp"]), f"single-{turn}")
            more = work.table(_pairs(fresh, some, num, den), f"links-{turn}")
            tried = work.table(tried.unionByName(fresh).distinct(), f"tried-{turn}")
            links = work.table(links.unionByName(more), f"all-{turn}")
            work.forget(*[f"{t}-{turn}" for t in ("members", "pairs", "sets", "single")])
            if not more.isEmpty():
                labels = components(links, work, f"c{turn + 1}")
        keyed = signed.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left")
    else:
        keyed = signed.withColumn("label", F.lit(None).cast("long"))
    work.forget("shared", "nodes", "stars", "reps", "roles", "checked", "info", *[f"{t}-{i}" for t in ("mixed", "tried", "all", "links") for i in range(len(QUOTAS))])
    keyed = keyed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("label", "fp")).alias("key"))
    least = work.table(keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least")), "least")
    out = keyed.join(least, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def oracle(words: int = 4, num: int = 85, den: int = 100) -> str:
    """The same in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    i AS (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - {words} + 2, 2) AS BIGINT))) AS i FROM d WHERE len(w) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {words} - 1], ' ') AS g FROM i),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE {den} * c >= {num} * (a.n + b.n - c)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id)
    SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.m) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """
