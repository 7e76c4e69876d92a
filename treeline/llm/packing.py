"""Best-fit packing by length-histogram planning.

Documents become pieces of at most `capacity` tokens. The plan is made on the histogram of piece
lengths (at most `capacity` counts, whatever the corpus): best-fit decreasing over counts, where all
bins with equal contents are one entry with a multiplicity. Pieces then take their planned slots by a
join on their rank within their length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import KEPT, Workspace, id_text, slices, tidy
from treeline.llm.token_count import tokenizer

CAPACITY = 4096
END_ID = 1
#: Distinct word pieces whose ids a Python worker keeps (about 200 bytes each), unless told otherwise.
CACHE_PIECES = 600_000
#: New pieces encoded together: what the library returns of a token takes some 250 bytes.
LEARNED = 8192
#: Characters from which a text is encoded in parts.
PART_CHARS = 1 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


# The pieces into which the vocabulary's own pre-tokeniser cuts. Its pattern for lower-case Latin
# text. Texts that hold other characters, in lower case or as they stand, or what may be a special string go to the
# library whole.
_LETTERS, _DIGITS = "a-zªµºß-öø-ɏ", "0-9²³¹¼½¾"
_CUT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_DIGITS}{_LETTERS}]+").findall
_OTHER = re.compile(r"[^ -~\n\r\t¡-ÖØ-öø-įı-ɏ]|<\|").search
_BLANK = re.compile(r"[ \n\r\t]").search


class WordIds(dict):
    """Piece -> ids as little-endian unsigned 32-bit bytes; texts() gives those of whole texts.

    The vocabulary drops white space, lower-cases and merges within pieces only, so a text's ids are those of
    its pieces in order. Pieces repeat far more than texts: the first met, up to a number, are kept, others
    as long as a slice of texts needs them. A piece counts as known only if the library, too, took it for one word;
    a text with any other piece goes to the library whole. Which pieces are kept never changes ids.
    """

    def __init__(self, tok, most: int = CACHE_PIECES):
        super().__init__()
        self.tok, self.most, self.passing = tok, most, {}

    def __missing__(self, piece: str) -> bytes | None:
        return self.passing[piece]

    def library(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """New pieces are encoded together, apart by blanks. Where the library's words don't lie exactly on
        the pieces, halves are tried apart, down to single pieces, which then aren't known (None)."""
        e = self.tok.encode(" ".join(new), add_special_tokens=False)
        word = np.array(e.word_ids, np.int64)
        spans = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(word)).reshape(-1, 2)
        first = np.flatnonzero(np.diff(word, prepend=-1))  # tokens that begin a word
        begins = np.cumsum([0] + [len(p) + 1 for p in new])
        if (
            len(first) == len(new)
            and (spans[first, 0] == begins[:-1]).all()
            and (spans[np.r_[first[1:], len(word)] - 1, 1] == begins[1:] - 1).all()
        ):
            ids, ends = np.asarray(e.ids, "<u4").tobytes(), (4 * np.r_[first, len(word)]).tolist()
            found: list = [ids[i:j] for i, j in zip(ends, ends[1:])]
        elif len(new) == 1:
            found = [None]
        else:
            self._learn(new[: len(new) // 2])
            self._learn(new[len(new) // 2 :])
            return
        into = self if len(self) + len(new) <= self.most else self.passing
        into.update(zip(new, found))

    def _ids(self, text: str, cut: list[str] | None) -> bytes:
        try:
            return self.library(text) if cut is None else b"".join(map(self.__getitem__, cut))
        except TypeError:  # a piece that isn't known
            return self.library(text)

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of every text. Long texts are encoded part by part, so that memory holds one part's pieces."""
        if max(map(len, texts), default=0) <= PART_CHARS:
            return self._together(texts)
        return [b"".join(self._together([p])[0] for p in parts(t)) for t in texts]

    def _together(self, texts: list[str]) -> list[bytes]:
        cut = []
        for t in texts:
            low = t.lower()
            cut.append(None if _OTHER(low) or not t.isascii() and _OTHER(t) else _CUT(low))
        self.passing = {}
        new = [p for p in set().union(*filter(None, cut)) if p not in self]
        for i in range(0, len(new), LEARNED):
            self._learn(new[i : i + LEARNED])
        return list(map(self._ids, texts, cut))


def parts(text: str) -> Iterator[str]:
    """A text divided at ASCII white space, which lies between words, into parts of PART_CHARS or a little more. An
    endless word is not divided."""
    begin = 0
    while (found := _BLANK(text, begin + PART_CHARS)) is not None:
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:]


_WORD_IDS: dict[tuple[str, int], WordIds] = {}
KEPT["packing"] = _WORD_IDS


def word_ids(vocabulary: str, most: int = CACHE_PIECES) -> WordIds:
    """Once per vocabulary and Python worker."""
    if (vocabulary, most) not in _WORD_IDS:
        _WORD_IDS.clear()
        _WORD_IDS[vocabulary, most] = WordIds(tokenizer(vocabulary), most)
    return _WORD_IDS[vocabulary, most]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, count, first sequence, offset).

    Bins with the same free space and contents stand as one group [first sequence, how many]. For each
    length, longest first, its items go to the fullest groups they fit in, one each; what is left opens
    new bins, each filled with as many of the length as fit. Few more rows than distinct lengths result.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # free space -> [(first sequence, how many)]
    spaces: list[int] = []  # its keys, ascending
    rows, sequences = [], 0

    def put(free: int, first: int, many: int) -> None:
        if free and many:
            if free not in groups:
                bisect.insort(spaces, free)
            groups.setdefault(free, []).append((first, many))

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):  # nothing has room: open as many bins as the rest fills
                opened = -(-left // (capacity // length))
                first, many, free = sequences, opened, capacity
                sequences += opened
            else:
                free = spaces[at]
                first, many = groups[free].pop()
                if not groups[free]:
                    del groups[free], spaces[at]
            take = min(many, left)
            rows.append((length, rank, take, first, capacity - free))
            put(free - length, first, take)
            put(free, first + take, many - take)
            rank, left = rank + take, left - take
    return rows


def pieces(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID, cached: int = CACHE_PIECES
) -> DataFrame:
    """One row per piece, with its task and its place among the task's pieces of equal length."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encode = word_ids(vocabulary, cached).texts
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    for i, begin in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - begin)
                        crc = zlib.crc32(ids[4 * begin : 4 * (begin + length)])
                        out.append((doc, i, begin, length, crc, task, int(seen[length])))
                        seen[length] += 1
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return id_text(docs).mapInArrow(tidy(run, "packing"), PIECES)


def pack(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID, cached: int = CACHE_PIECES
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of docs.

    A null or empty text is one piece holding the end id alone; repeated rows are packed each; an empty
    table gives no rows; other columns are ignored. Only texts over the capacity are cut. A worker keeps the ids of
    so many cached word pieces; the number trades memory for time and changes no result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    cut = work.table(pieces(docs, vocabulary, capacity, end_id, cached), "pieces")
    # Rank within a length = pieces of that length in earlier tasks + place in the own task: no window over pieces.
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("many"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "task", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["many"] for r in counts.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    rows = plan(histogram, capacity)
    slots = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, first long, many long, seq long, offset long")
    slots = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "many", "seq", "offset"))).alias("slots"))
    ranked = cut.join(F.broadcast(before), ["length", "task"]) if _small(before) else cut.join(before, ["length", "task"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth"))
    planned = F.broadcast(slots)  # bounded by the capacity, not by the corpus
    placed = ranked.join(planned, "length").withColumn("slot", _find("slots", "rank"))
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("slot.seq") + F.col("rank") - F.col("slot.first")).alias("sequence_id"),
        F.col("slot.offset").alias("offset"),
    )


def _small(df: DataFrame, rows: int = 200_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def _find(slots: str, rank: str):
    """The slot of a length's plan that holds a rank."""
    return F.element_at(F.filter(slots, lambda s: (s["first"] <= F.col(rank)) & (F.col(rank) < s["first"] + s["many"])), 1)
