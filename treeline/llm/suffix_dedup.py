"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A position is repeated if the `window` bytes from it also start elsewhere. Suffixes are sorted one bucket at a
time, and only those that can be repeated:

1. Buckets. A suffix's bucket is the smallest hash of the ANCHOR-byte strings in its window, so equal
   windows share a bucket wherever they lie. Neighbouring suffixes mostly share it too and travel as one run.
2. Runs alone in their bucket are unique. Runs with equal contents are repeated as a whole. What is left are
   unlike runs of one bucket; only their bytes are fetched.
3. Blocks of whole buckets are suffix-sorted in bounded memory: by their first DEPTH bytes, long ties by
   precomputed ranks of a difference-cover sample (for any two suffixes some shift below the cover's
   period puts both on sampled positions, which are ranked to the full window). Neighbours in the
   order that agree on a whole window are repeated.

Buckets with more unlike runs than LIMIT, as a very common line makes, would not fit a block. Their windows are
lined up by the bucket's string and cut into blocks of STEPS places. The bytes that all windows of a block share are
a longer string than the bucket's, and make buckets of their own: equal windows still share one. A block
alone in its bucket goes, blocks with equal contents are repeated as a whole, buckets of up to LIMIT blocks are
sorted like any other, and only larger ones are cut again, down to single windows.
Bucket and contents are independent 64-bit hashes; texts are known by a 64-bit hash. Equal texts are one text,
repeated from end to end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import Workspace, id_text, slices, tidy

WINDOW = 200
ANCHOR = 64
#: Unlike runs of a bucket that are sorted together.
LIMIT = 512
#: Suffixes of one run at most, and of one piece of a text when runs are found.
RUN, CHUNK = 1024, 1 << 16
#: Places of windows, relative to their bucket's string, that make the smaller buckets of large ones.
STEPS = (16, 4, 1)
#: Bytes of run contents sorted at once.
BLOCK = 1 << 20
DEPTH = 64
#: Buckets common in a bounded sample (documents smallest by hash of the id) are dealt by contents at once.
HOT_SAMPLE, HOT_SHARE = 2000, 0.02
#: Text keys up to which a set of them is broadcast (8 bytes each).
BROADCAST_KEYS = 1_000_000
SEEN = 1_000_000

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes; powers of the base and of its inverse modulo 2^64."""
    values = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
    power, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    power[0] = inverse[0] = 1
    return values, np.cumprod(power), np.cumprod(inverse)


def _size(n: int) -> int:
    return 1 << max(12, (n + 1).bit_length())


class Rolling:
    """Hashes of substrings of a byte array."""

    def __init__(self, data: np.ndarray):
        values, power, self.inverse = _tables(_size(len(data)))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def all(self, length: int) -> np.ndarray:
        many = len(self.sums) - length
        return (self.sums[length:] - self.sums[:many]) * self.inverse[:many]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, in linear time."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def find_runs(pieces: list[tuple[int, int, bytes]], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, position, suffixes, bucket, contents hash, periodic) of all runs of pieces (document, offset,
    bytes). Only a run that holds its bucket's string twice, a periodic one, can repeat a window in itself."""
    from xxhash import xxh3_64_intdigest

    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    lengths = np.array([len(p[2]) for p in pieces])
    starts = np.cumsum(lengths) - lengths
    rolling = Rolling(data)
    grams, w = _mix(rolling.all(anchor)), window - anchor + 1
    low = _sliding_min(grams, w)
    # A string is smallest in some window if the largest minimum of the windows that hold it is its own.
    around = np.zeros(len(low) + 2 * (w - 1), np.uint64)
    around[w - 1 : w - 1 + len(low)] = low
    chosen = np.flatnonzero(~_sliding_min(~around, w) == grams)
    again = (np.diff(chosen) <= w) & (grams[chosen[1:]] == grams[chosen[:-1]])
    twice = np.unique(grams[chosen[1:][again]]) if len(chosen) else grams[:0]
    many = lengths - window + 1
    owner = np.repeat(np.arange(len(pieces)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + starts[owner]
    bucket = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    first = np.flatnonzero(new | (since % RUN == 0))
    size = np.diff(np.r_[first, len(at)])
    view, ends = memoryview(data), at[first] + size + window - 1
    contents = np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in zip(at[first].tolist(), ends.tolist())), np.uint64, len(first))
    who = owner[first]
    docs, offsets = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    periodic = np.isin(bucket[first], twice)
    return docs[who], at[first] - starts[who] + offsets[who], size, bucket[first].view(np.int64), contents.view(np.int64), periodic


def _pieces(i: int, data: bytes, window: int) -> Iterator[tuple[int, int, bytes]]:
    for offset in range(0, len(data) - window + 1, CHUNK):
        yield i, offset, data[offset : offset + CHUNK + window - 1]


def _batches_of_pieces(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    held, size = [], 0
    for i, t in enumerate(texts):
        for p in _pieces(i, t, window):
            held.append(p)
            size += len(p[2])
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _hot(texts: DataFrame, window: int, anchor: int) -> np.ndarray:
    """Buckets common in the bounded sample; they only decide how rows are dealt."""
    chosen = texts.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(HOT_SAMPLE).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for held in _batches_of_pieces([t.encode() for t in part.column("text").to_pylist()], window):
                    doc, _, _, bucket, _, _ = find_runs(held, window, anchor)
                    pairs = np.unique(np.stack([doc, bucket]), axis=1)
                    e, n = np.unique(pairs[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(n)], names=["e", "n"])

    rows = texts.join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(tidy(run), "e long, n long")
    found = rows.groupBy("e").agg(F.sum("n").alias("n")).where(F.col("n") >= max(20, int(HOT_SHARE * HOT_SAMPLE)))
    return np.sort(np.array([r["e"] for r in found.select("e").collect()], np.int64))  # bounded by the sample


def _runs(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(bucket, contents, key, place) of the runs of each task's distinct texts.

    place = position << 14 | suffixes << 3 | periodic << 2 | known << 1 | bypass. Within a slice, one run speaks for those with
    equal contents: it is `known` to be repeated, and the others, known too, bypass the buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                keys = np.array(part.column("key"), np.int64)
                texts, owners = [], []
                for i, (key, text) in enumerate(zip(keys.tolist(), part.column("text").to_pylist())):
                    if key not in seen and len(data := text.encode()) >= window:
                        seen.add(key)
                        texts.append(data)
                        owners.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                for held in _batches_of_pieces(texts, window):
                    doc, position, size, bucket, contents, periodic = find_runs(held, window, anchor)
                    order = np.lexsort((contents, bucket))
                    b, c = bucket[order], contents[order]
                    new = np.ones(len(b), bool)
                    new[1:] = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
                    group = np.cumsum(new) - 1
                    known = np.bincount(group)[group] > 1
                    place = (position[order].astype(np.int64) << 14) | (size[order] << 3) | (periodic[order] << 2) | (known << 1) | ~new
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(b), pa.array(c), pa.array(keys[np.array(owners)[doc[order]]]), pa.array(place.astype(np.int64))],
                        names=["bucket", "contents", "key", "place"],
                    )

    return texts.select("key", "text").mapInArrow(tidy(run), "bucket long, contents long, key long, place long")


#: What becomes of a run: repeated as a whole; bytes to be sorted, as a candidate or only as a partner;
#: or, in a large bucket, cut to blocks, likewise.
WHOLE, SORT, PARTNER, HASH, HASH_PARTNER = range(5)


def _decided(runs: DataFrame, hot: np.ndarray, limit: int) -> DataFrame:
    """(key, position, size, bucket, fate) of all runs that are or may be repeated."""

    def settle(bucket, contents, key, place, forced: bool, out: list) -> None:
        """Whole buckets, sorted by bucket and contents."""
        if not len(bucket):
            return
        newb = np.r_[True, bucket[1:] != bucket[:-1]]
        newc = newb | np.r_[True, contents[1:] != contents[:-1]]
        c0, b0 = np.flatnonzero(newc), np.flatnonzero(newb)
        cid, bid = np.cumsum(newc) - 1, np.cumsum(newb) - 1
        ident = _mix(key.view(np.uint64) * _P + (place >> 14).astype(np.uint64))
        whole = (np.minimum.reduceat(ident, c0) != np.maximum.reduceat(ident, c0)) | (np.maximum.reduceat((place >> 1) & 1, c0) > 0)
        kinds = np.add.reduceat(newc.astype(np.int64), b0)  # unlike contents per bucket
        single = np.bincount(bid[c0], ~whole, minlength=len(b0))  # of which not repeated as they are
        special = np.isin(bucket[b0], hot) | forced | (kinds > limit)
        fate = np.full(len(bucket), -1)
        fate[whole[cid]] = WHOLE
        lone = newc & ~whole[cid] & ((kinds[bid] > 1) | special[bid] | (((place >> 2) & 1) > 0))
        fate[lone] = np.where(special[bid][lone], HASH, SORT)
        keep = fate >= 0
        partner = newc & whole[cid] & (((kinds[bid] > 1) & (single[bid] > 0)) | special[bid])
        for rows, f in ((keep, fate[keep]), (partner, np.where(special[bid][partner], HASH_PARTNER, PARTNER))):
            out.append((key[rows], place[rows] >> 14, (place[rows] >> 3) & 2047, bucket[rows], f))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        open_hot = None  # bucket so large that its first part has been settled
        names = ("bucket", "contents", "key", "place")

        def rows_of(out):
            cols = [np.concatenate([o[i] for o in out]) for i in range(5)] if out else [np.empty(0, np.int64)] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int64)) for x in cols[:4]] + [pa.array(cols[4].astype(np.int32))], names=["key", "position", "size", "bucket", "fate"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            out: list = []
            got = [np.array(batch.column(n), np.int64) for n in names]
            aside = (got[3] & 1) == 1
            if aside.any():
                out.append((got[2][aside], got[3][aside] >> 14, (got[3][aside] >> 3) & 2047, got[0][aside], np.full(aside.sum(), WHOLE)))
                got = [x[~aside] for x in got]
            rows = [np.concatenate(x) for x in zip(held, got)]
            if len(rows[0]):
                cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on
                if open_hot is not None and len(rows[0]) and rows[0][0] == open_hot and cut:
                    end = int(np.searchsorted(rows[0], open_hot, side="right"))
                    settle(*(x[:end] for x in rows), True, out)
                    rows = [x[end:] for x in rows]
                    cut -= end
                    open_hot = None
                settle(*(x[:cut] for x in rows), False, out)
                rows = [x[cut:] for x in rows]
                if len(rows[0]) > 4 * limit:  # settle all but its last contents
                    cut = int(np.searchsorted(rows[1], rows[1][-1]))
                    if cut:
                        settle(*(x[:cut] for x in rows), True, out)
                        open_hot = int(rows[0][-1])
                        rows = [x[cut:] for x in rows]
                held = rows
            yield rows_of(out)
        out = []
        settle(*held, open_hot is not None and len(held[0]) > 0 and held[0][0] == open_hot, out)
        yield rows_of(out)

    hot_values = [int(x) for x in hot]
    by = F.when((F.col("place").bitwiseAND(1)) == 1, F.xxhash64("key", "place"))
    if hot_values:
        by = by.when(F.col("bucket").isin(hot_values), F.xxhash64("bucket", "contents"))
    rows = runs.repartition(by.otherwise(F.xxhash64("bucket"))).sortWithinPartitions("bucket", "contents")
    return rows.mapInArrow(tidy(run), "key long, position long, size long, bucket long, fate int")


@lru_cache
def difference_cover(period: int = 57) -> tuple[np.ndarray, np.ndarray]:
    """(sampled residues, shift[a, b]): the residues' differences give every residue, so shifting suffixes with
    residues a and b by shift[a, b] puts both on sampled residues. Found by greedy search."""
    chosen, missing = [0, 1], set(range(period)) - {0, 1, period - 1}
    while missing:
        gain = lambda x: len({d for c in chosen for d in ((x - c) % period, (c - x) % period)} & missing)
        chosen.append(max((x for x in range(period) if x not in chosen), key=lambda x: (gain(x), -x)))
        missing -= {(a - b) % period for a in chosen for b in chosen}
    cover = np.array(sorted(chosen))
    shift = np.zeros((period, period), np.int64)
    inside = set(chosen)
    for a in range(period):
        for b in range(period):
            shift[a, b] = next(s for s in range(period) if (a + s) % period in inside and (b + s) % period in inside)
    return cover, shift


def _words(data: np.ndarray, at: np.ndarray, count: int) -> list[np.ndarray]:
    """Big-endian 8-byte words of the strings at the given positions."""
    view = np.lib.stride_tricks.sliding_window_view(data, 8)
    return [view[at + 8 * i].copy().view(">u8").ravel().astype(np.uint64) for i in range(count)]


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of key tuples, first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_suffixes(contents: list[bytes], sizes: list[int], groups: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For each run, which of its suffixes have a whole window that also starts in another place of the same group.

    Suffixes are sorted by group and DEPTH bytes; ties are ordered by three-way partitioning whose
    comparisons look up cover-sample ranks, all ties of a round at once.
    """
    period = 57
    cover, shift = difference_cover(period)
    pad = window + DEPTH + 2 * period + 16
    data = np.frombuffer(b"".join(contents) + bytes(pad), np.uint8)
    lengths = np.array([len(c) for c in contents])
    starts = np.cumsum(lengths) - lengths
    size = np.array(sizes)
    run = np.repeat(np.arange(len(size)), size)
    at = starts[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    # Ranks of the sampled positions, doubled until they cover a window.
    top = int(lengths.sum())
    sampled = np.zeros(period, bool)
    sampled[cover] = True
    places = np.flatnonzero(np.resize(sampled, top + period))
    places = places[places + DEPTH + 8 <= len(data)]
    rank = np.full(len(data) + 2 * window, -1, np.int64)
    rank[places] = _ranks(_words(data, places, DEPTH // 8))
    depth = DEPTH
    while depth < window:
        step = depth // period * period
        rank[places] = _ranks([rank[places], rank[places + step]])
        depth += step
    # First DEPTH bytes.
    tie = _ranks([np.array(groups)[run], *_words(data, at, DEPTH // 8)])
    order = np.argsort(tie, kind="stable")
    at_, run_, group = at[order], run[order], tie[order]
    tied = group.copy()
    # Three-way partitioning of all ties at once.
    open_ = np.arange(len(order))
    while True:
        g = group[open_]
        new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.empty(0, bool)
        first = np.flatnonzero(new)
        many = np.diff(np.r_[first, len(g)])
        alive = np.repeat(many > 1, many)
        open_ = open_[alive]
        if not len(open_):
            break
        g = group[open_]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        many = np.diff(np.r_[first, len(g)])
        pivot = np.repeat(at_[open_[first + many // 2]], many)
        mine = at_[open_]
        s = shift[mine % period, pivot % period]
        side = np.sign(rank[mine + s] - rank[pivot + s]) + 1
        local = np.repeat(np.arange(len(first)), many)
        moved = np.argsort(local * 3 + side, kind="stable")
        code = (local * 3 + side)[moved]
        at_[open_], run_[open_] = mine[moved], run_[open_][moved]
        cuts = np.r_[True, code[1:] != code[:-1]]
        # New groups are numbered by where they start; those equal to their pivot are done.
        base = open_[np.flatnonzero(cuts)]
        group[open_] = np.repeat(base, np.diff(np.r_[np.flatnonzero(cuts), len(code)])) + len(tied) + 1
        open_ = open_[code % 3 != 1]
    # Neighbours with equal windows.
    same = np.flatnonzero(tied[1:] == tied[:-1]) if len(tied) else np.empty(0, np.int64)
    for i in range(DEPTH // 8, -(-window // 8)):
        offset = min(8 * i, window - 8)
        view = np.lib.stride_tricks.sliding_window_view(data, 8)
        a = view[at_[same] + offset].copy().view(np.uint64).ravel()
        b = view[at_[same + 1] + offset].copy().view(np.uint64).ravel()
        same = same[a == b]
    hit = np.zeros(int(size.sum()), bool)
    back = np.cumsum(size) - size
    for x in (same, same + 1):
        hit[back[run_[x]] + at_[x] - starts[run_[x]]] = True
    return np.split(hit, np.cumsum(size)[:-1]) if len(size) else []


BLOCKS = "core long, whole long, key long, position long, size long, lead int, candidate boolean, bytes binary"


def _refined(key: int, position: int, size: int, lead: int, candidate: bool, content: bytes, step: int, window: int) -> Iterator[tuple]:
    """Blocks of a stretch of windows that see the bucket's string from lead, lead - 1, ... bytes ahead: a block holds the
    windows of one `step` of places. core hashes what all windows of that step share, whole the block itself."""
    from xxhash import xxh3_64_intdigest, xxh64_intdigest

    begin = 0
    while begin < size:
        least = (lead - begin) // step * step
        end = min(size, lead - least + 1)
        part = content[begin : end + window - 1]
        core = content[lead - least : lead - least - step + 1 + window]
        yield (
            xxh3_64_intdigest(core) - 2**63, xxh64_intdigest(part, end - begin) - 2**63, key, position + begin, end - begin, lead - begin, candidate,
            part if step > 1 else None,
        )
        begin = end


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.bool_(), pa.binary()]
    cols = list(zip(*rows)) or [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in BLOCKS.split(", ")])


def _fetched(texts: DataFrame, runs: DataFrame, keys: DataFrame, window: int, anchor: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Bytes of runs to be sorted, and first blocks of runs in large buckets."""
    wanted = runs.where(F.col("fate") != WHOLE)
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("position", "size", "bucket", "fate")).alias("runs"))  # runs of one text
    lists = lists.join(keys.select("key", "row"), "key")
    lists = work.table(lists, "lists")
    small = lists.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    rows = texts.select("key", "row", "text")
    if small:
        rows = rows.join(F.broadcast(lists.select("key", "row")), ["key", "row"], "left_semi")
    rows = rows.join(lists, ["key", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "position", "size", "bucket", "fate", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        last = None
        for batch in batches:
            for part in slices(batch):
                out = []
                for key, text, runs_ in zip(*(part.column(c).to_pylist() for c in ("key", "text", "runs"))):
                    if key == last:  # repeated rows of one id and text
                        continue
                    last = key
                    data = text.encode()
                    out += [(key, r["position"], r["size"], r["bucket"], r["fate"], data[r["position"] : r["position"] + r["size"] + window - 1]) for r in runs_]
                cols = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    schema = "key long, position long, size long, bucket long, fate int, bytes binary"
    got = work.table(rows.select("key", "text", "runs").mapInArrow(tidy(run), schema), "fetched")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, position, size, bucket, fate, content in zip(*(batch.column(c).to_pylist() for c in names)):
                grams = _mix(Rolling(np.frombuffer(content, np.uint8)).all(anchor)).view(np.int64)
                spots = np.flatnonzero(grams == bucket)
                at = spots[np.searchsorted(spots, np.arange(size))]
                cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]).tolist() + [size]
                for a, b in zip(cuts, cuts[1:]):
                    out += _refined(key, position + a, b - a, int(at[a]) - a, fate == HASH, content[a : b + window - 1], STEPS[0], window)
            yield _block_batch(out)

    names = ("key", "position", "size", "bucket", "fate", "bytes")
    large = got.where(F.col("fate").isin(HASH, HASH_PARTNER)).select(*names)
    return got.where(F.col("fate").isin(SORT, PARTNER)), large.mapInArrow(tidy(first), BLOCKS)


def _large_buckets(blocks: DataFrame, window: int, limit: int, work: Workspace) -> tuple[list[DataFrame], list[DataFrame]]:
    """From the first blocks of runs in large buckets: (key, first, last) byte intervals of repeated windows, and blocks
    to be sorted, as rows for _sorted_blocks."""
    found, to_sort = [], []
    for turn, step in enumerate(STEPS):
        blocks = work.table(blocks, f"blocks-{turn}")
        if blocks.isEmpty():
            break
        ident = F.xxhash64("key", "position")
        of = lambda *by: blocks.groupBy(*by).agg(F.min(ident).alias("a"), F.max(ident).alias("b")).where("a <> b").select(*by)
        equal = work.table(of("core", "whole").withColumn("equal", F.lit(True)), f"equal-{turn}")
        marks = blocks.where("candidate").join(equal.drop("equal"), ["core", "whole"], "left_semi")
        marks = marks.select("key", F.col("position").alias("first"), (F.col("position") + F.col("size") + window - 1).alias("last"))
        found.append(marks)
        if step == STEPS[-1]:
            break
        # Blocks that share a core with an open candidate go on; those already repeated are partners only.
        rest = blocks.join(equal, ["core", "whole"], "left").withColumn("candidate", F.col("candidate") & F.col("equal").isNull()).drop("equal")
        rest = work.table(rest, f"judged-{turn}")
        shared = rest.groupBy("core").agg(F.min(ident).alias("a"), F.max(ident).alias("b"), F.max("candidate").alias("open"), F.count("*").alias("members"))
        rest = rest.join(work.table(shared.where("a <> b and open").select("core", "members"), f"open-{turn}"), "core")
        # Of blocks equal to each other one is partner enough.
        alone = rest.where("candidate")
        one = rest.where("not candidate").withColumn("nth", F.row_number().over(Window.partitionBy("core", "whole").orderBy("key", "position")))
        rest = work.table(alone.unionByName(one.where("nth = 1").drop("nth")), f"rest-{turn}")
        fate = F.when(F.col("candidate"), SORT).otherwise(PARTNER).alias("fate")
        to_sort.append(rest.where(F.col("members") <= limit).select("key", "position", "size", F.col("core").alias("bucket"), fate, "bytes"))
        rest = rest.where(F.col("members") > limit)
        following = STEPS[turn + 1]

        def divide(batches: Iterator[pa.RecordBatch], following=following) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for key, position, size, lead, candidate, content in zip(*(batch.column(c).to_pylist() for c in ("key", "position", "size", "lead", "candidate", "bytes"))):
                    out += _refined(key, position, size, lead, candidate, content, following, window)
                yield _block_batch(out)

        blocks = rest.select("key", "position", "size", "lead", "candidate", "bytes").mapInArrow(tidy(divide), BLOCKS)
    return found, to_sort


def _sorted_blocks(rows: DataFrame, window: int) -> DataFrame:
    """(key, first, last) byte intervals of repeated windows in runs to be sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows_: list[tuple]) -> pa.RecordBatch:
            unique = list({(r[0], r[1], r[2]): r for r in rows_}.values())
            out = []
            if unique:
                ids = {b: i for i, b in enumerate(dict.fromkeys(r[0] for r in unique))}
                hits = repeated_suffixes([r[5] for r in unique], [r[3] for r in unique], [ids[r[0]] for r in unique], window)
                for r, hit in zip(unique, hits):
                    if r[4] == SORT and hit.any():
                        edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
                        out += [(r[1], r[2] + int(a), r[2] + int(b) - 1 + window) for a, b in zip(edge[::2], edge[1::2])]
            cols = list(zip(*out)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "first", "last"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "position", "size", "fate", "bytes"))):
                if size > BLOCK and r[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        yield flush(held)

    rows = rows.select("bucket", "key", "position", "size", "fate", "bytes").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(tidy(run), "key long, first long, last long")


def repeated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, limit: int = LIMIT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, Workspace]:
    """(texts, rows, keys, spans, workspace): texts with their key; a row per text without it; per key how many
    rows; and per key of a text that stands once, its repeated byte intervals."""
    work = Workspace(docs.sparkSession, "suffix")
    texts = id_text(docs).withColumn("key", F.xxhash64("text")).withColumn("row", F.coalesce("doc_id", F.lit(-(2**63))))
    runs = _runs(texts, window, anchor)
    fates = work.table(_decided(runs, _hot(texts, window, anchor), limit), "fates")
    rows = texts.select("doc_id", "row", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("own"))
    rows = work.table(rows, "rows")
    keys = work.table(rows.groupBy("key").agg(F.count("*").alias("many"), F.min("row").alias("row")), "keys")
    sort, large = _fetched(texts, fates, keys, window, anchor, work)
    whole = fates.where(F.col("fate") == WHOLE).select("key", F.col("position").alias("first"), (F.col("position") + F.col("size") + window - 1).alias("last"))
    found, more = _large_buckets(large, window, limit, work)
    for rows_ in more:
        sort = sort.select("key", "position", "size", "bucket", "fate", "bytes").unionByName(rows_)
    spans = whole.unionByName(_sorted_blocks(sort, window))
    for marks in found:
        spans = spans.unionByName(marks)
    once = keys.where("many = 1").select("key")
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans")).join(once, "key", "left_semi")  # spans of one text
    spans = work.table(spans, "spans")
    work.forget("fates", "lists", "fetched", *[f"{n}-{i}" for n in ("blocks", "equal", "judged", "open", "rest") for i in range(len(STEPS))])
    return texts, rows, keys, spans, work


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def _cut_texts(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, n_removed, n_spans, kept) of the texts that have spans."""
    small = spans.select("key").limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    rows = texts.select("key", "text")
    if small:
        rows = rows.join(F.broadcast(spans.select("key")), "key", "left_semi")
    rows = rows.join(spans, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for key, text, found in zip(*(part.column(c).to_pylist() for c in ("key", "text", "spans"))):
                    data, merged, at, kept = text.encode(), _merged(found), 0, []
                    for a, b in merged:
                        kept.append(data[at:a])
                        at = b
                    kept.append(data[at:])
                    out.append((key, sum(b - a for a, b in merged), len(merged), b"".join(kept)))
                cols = list(zip(*out)) or [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(tidy(run), "key long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of docs: every byte covered by a window-byte
    string that also starts anywhere else goes.

    Null and empty texts have nothing to remove; texts shorter than the window neither. Equal texts (repeated rows
    too) of window bytes or more go whole. Texts of any length are taken whole, in pieces that overlap by a window.
    An empty table gives no rows; a null id is as good as any; other columns are ignored.
    """
    texts, rows, keys, spans, work = repeated(docs, window)
    cut = _cut_texts(texts, spans).select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    changes = work.table(cut, "changes")
    copies = keys.where("many > 1").select("key", F.lit(True).alias("copied"))
    rows = rows.join(changes, "key", "left").join(work.table(copies, "copies"), "key", "left")
    gone = F.col("copied").isNotNull() & (F.col("n_bytes") >= window)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"),
    )


def remove(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the repeated bytes taken out of their texts; characters cut in part go too. Unchanged
    texts, null and empty ones among them, stay as they are; equal texts of a window or more become empty; no row
    goes. Other columns stay, whatever their names."""
    texts, _, keys, spans, work = repeated(docs, window)
    kept = work.table(_valid(_cut_texts(texts, spans)), "kept")
    copies = work.table(keys.where("many > 1").select(F.col("key").alias("__copied")), "copies")
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    rows = docs.join(kept, key == kept["__of"], "left").join(copies, key == copies["__copied"], "left")
    gone = copies["__copied"].isNotNull() & (F.octet_length(docs[text_col]) >= window)
    new = F.when(gone, F.lit("")).otherwise(F.coalesce(kept["__kept"], docs[text_col]))
    return rows.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])


def _valid(cut: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(kept, pa.string())], names=["__of", "__kept"])

    return cut.select("key", "kept").mapInArrow(tidy(run), "__of long, __kept string")
