"""Token counts by overlap resynchronisation.

Ordinary texts are encoded whole. A huge text is encoded in overlapping chunks with offsets and the
chunks are spliced where both agree on a boundary that is proven stable:

* Pre-tokenisation scans left to right and keeps no state between matches. If two scans both start
  a match at character p, both see the same text from there, so they agree from p on, as far as
  the shorter chunk goes.
* A match that ends well before a chunk's end cannot have been changed by the cut, as patterns look at
  most one character ahead and a special string is shorter than GUARD characters.

So chunk A's tokens up to p and chunk B's tokens from p are the whole text's tokens. A boundary between
merge tokens inside one pre-token proves nothing, hence only pre-token (word) boundaries count. If the
overlap holds no common boundary, it is doubled until it does; a chunk that holds no boundary at all (one endless
word) is lengthened fourfold, so such a word is encoded about 4/3 times its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import id_text, slices

#: Texts longer than this many characters are encoded in chunks of it.
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 512
#: Characters before a chunk's end in which nothing is proven; over the longest special string + 1.
GUARD = 32

_TOKENIZERS: dict[str, object] = {}


def tokenizer(name: str):
    """The tokenizer of a vocabulary file, loaded once per Python worker. Offsets are left untrimmed;
    ids don't depend on that."""
    if name not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.processors import ByteLevel

        t = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        if t.post_processor is None:
            t.post_processor = ByteLevel(trim_offsets=False)
        _TOKENIZERS[name] = t
    return _TOKENIZERS[name]


def _words(encoding) -> dict[int, int]:
    """Start of each pre-token (character) -> index of its first token."""
    starts: dict[int, int] = {}
    last = None
    for i, (word, (begin, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word is None or word != last:
            starts[begin] = i
            last = word
    return starts


def resync_ids(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Ids of a huge text; equal to encoding it whole, with memory for a few chunks only."""
    n = len(text)
    encode = lambda a, b: tok.encode(text[a:b], add_special_tokens=False)
    ids: list[int] = []
    begin, end = 0, min(n, chunk)
    current = encode(begin, end)
    skip = 0  # tokens of the current chunk that belong to the one before
    while end < n:
        wide = overlap
        while True:
            # Proven boundaries of the current chunk beyond the last splice.
            mine = {begin + p: i for p, i in _words(current).items() if i > skip and 1 < p <= end - begin - GUARD}
            common: list[int] = []
            if mine:
                start = max(begin + 1, max(mine) - wide)
                stop = min(n, start + chunk + wide)
                following = encode(start, stop)
                other = {start + p: i for p, i in _words(following).items() if p > 0}
                common = [p for p in mine.keys() & other.keys() if start < p <= stop - GUARD or stop == n]
                if common:
                    break
            if not mine or start == begin + 1:  # one word over the whole chunk: lengthen it, fourfold
                end = min(n, begin + 4 * (end - begin))
                current = encode(begin, end)
                if end == n:
                    break
            wide *= 2
        if not common:
            break
        p = max(common)
        ids += current.ids[skip : mine[p]]
        skip, current, begin, end = other[p], following, start, stop
    return ids + current.ids[skip:]


def count_tokens(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, chunk: int = CHUNK_CHARS
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs.

    A null or empty text has 0 bytes and 0 tokens; repeated rows and null ids give a row each; an empty
    table gives no rows; other columns are ignored. No shuffle: each task reads and counts its own rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                counts = [0] * len(texts)
                for i, e in zip(short, tok.encode_batch_fast([texts[i] for i in short], add_special_tokens=False)):
                    counts[i] = len(e.ids)
                for i, t in enumerate(texts):
                    if len(t) > chunk:
                        counts[i] = len(resync_ids(tok, t, chunk))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    texts = id_text(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    out = texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
