import random
import zlib

import numpy as np
import pytest

from treeline.llm import lang_id, packing, token_count
from treeline.llm.common import slices

SCHEMA = "doc_id long, text string, lang string, n_tokens string, score int"
WEIRD = [
    None, "", " ", "a", "hello  world\n\n x", "<|endoftext|>ab<|endoftext|>", "naïve ﬁ é  x", "I'll 12 34!!",
    "<|startoftext|> The <|endoftext|>", "日本語 text", "x" * 5000, "\x1c a\x1fb",
]


def docs(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def library(name, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_counts_equal_the_library(spark):
    texts = WEIRD + [WEIRD[4]]
    got = {r.doc_id: r for r in token_count.count_tokens(docs(spark, texts)).collect()}
    for i, ids in enumerate(library("byte_bpe_50k.json", texts)):
        assert got[i].n_tokens == len(ids) and got[i].n_bytes == len((texts[i] or "").encode())
        assert got[i].over_limit == (len(ids) > 1024)
    assert token_count.count_tokens(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_resynchronised_ids_equal_whole_encoding(seed):
    r = random.Random(seed)
    alphabet = ["a", "Zz", " ", "  ", "\n", "\n \n", "'ll", "12", "é", "!?", "<|endoftext|>", "日本", "\t", "word"]
    text = "".join(r.choice(alphabet) * r.choice([1, 1, 1, 3, 40]) for _ in range(400))
    if seed % 3 == 0:
        text = text[:300] + "q" * 900 + text[300:] + " " * 700 + text
    tok = token_count.tokenizer("byte_bpe_50k.json")
    assert token_count.resync_ids(tok, text, chunk=120, overlap=40) == library("byte_bpe_50k.json", [text])[0]


def test_resync_without_any_boundary():
    tok = token_count.tokenizer("byte_bpe_50k.json")
    text = "ab" * 2000
    assert token_count.resync_ids(tok, text, chunk=100, overlap=10) == library("byte_bpe_50k.json", [text])[0]


def test_packing_pieces_and_slots(spark):
    texts = WEIRD + ["word salad " * 4000, "a b c", "a b c"]
    out = packing.pack(docs(spark, texts)).collect()
    ids = [np.array(x + [1], "<u4") for x in library("word_bpe_49k.json", texts)]
    seen = {}
    for r in out:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.start == 4096 * r.piece and zlib.crc32(part.tobytes()) == r.ids_crc32
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(map(len, ids))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_gapless_and_tight(seed):
    r = random.Random(seed)
    hist = {r.randint(1, 4096 if seed else 5): r.randint(1, 500) for _ in range(300)}
    bins, ranks = {}, {}
    for length, first, many, seq, offset in packing.plan(hist):
        assert ranks.get(length, 0) == first
        ranks[length] = first + many
        for i in range(many):
            bins.setdefault(seq + i, []).append((offset, length))
    assert ranks == hist
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.25 * sum(k * v for k, v in hist.items()) / 4096 + 1


def test_language_of_held_out_rows(spark):
    en, de = "the quick brown fox jumps over the lazy dog and then the other", "der schnelle braune fuchs springt über den faulen hund und die katze"
    r = random.Random(1)
    texts, langs = [], []
    for i in range(120):
        words = (en if i % 2 else de).split()
        texts.append(" ".join(r.choice(words) for _ in range(20)))
        langs.append("en" if i % 2 else "de")
    texts += [None, "", "123 !!", texts[0]]
    langs += ["en", None, "de", "de"]
    got = {x.doc_id: x for x in lang_id.identify(docs(spark, texts, langs)).collect()}
    assert all(got[i].lang_pred == langs[i] for i in range(120))
    assert [got[i].lang_pred for i in (120, 121, 122)] == ["und"] * 3
    assert all(0 <= x.score <= 1 and x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items())
    assert lang_id.identify(docs(spark, [])).count() == 0


def test_slices_cover_a_batch():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (1, 50, 3, 0, 200, 7)])], names=["text"])
    parts = [p.column(0).to_pylist() for p in slices(b, limit=50)]
    assert sum(parts, []) == b.column(0).to_pylist() and len(parts) > 2


def test_endless_word_is_encoded_about_once():
    class Counting:
        def __init__(self, tok):
            self.tok, self.chars = tok, 0

        def encode(self, text, **more):
            self.chars += len(text)
            return self.tok.encode(text, **more)

    r = random.Random(4)
    word = "".join(r.choice("abcdefghij") for _ in range(200_000))
    tok = Counting(token_count.tokenizer("byte_bpe_50k.json"))
    for text in (word, "a few words " * 300 + word + " and some more" * 300):
        tok.chars = 0
        assert token_count.resync_ids(tok, text, chunk=2000) == library("byte_bpe_50k.json", [text])[0]
        assert tok.chars < 3 * len(text)


def test_text_beyond_a_chunk_through_the_operator(spark):
    texts = ["ab cd, " * 12_000, "x" * 70_000, None]
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs(spark, texts)).collect()}
    assert [got[i] for i in range(3)] == [len(x) for x in library("byte_bpe_50k.json", texts)]


def test_word_ids_equal_the_library_for_all_letters_and_random_texts():
    tok = token_count.tokenizer("word_bpe_49k.json")
    ids = packing.WordIds(tok)
    whole = lambda t: np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    letters = [chr(c) for c in range(0xA1, 0x250)]
    for c in letters:
        texts = ["Plain english words are here, and more of them.", c, f"x {c}! y", f"{c}.{c}", f"ab{c}cd 12{c}"]
        assert ids.texts(texts) == list(map(whole, texts))
    r = random.Random(2)
    parts = letters + list("abc XYZ  '\n\t.,;!?012<|>sdm") + ["'s", "'ll", "word", "The", "<|endoftext|>", "é", "日本", "Å", "K", "İ", "\x0b", "\xa0"]
    for _ in range(250):
        texts = ["plain words"] + ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(40)]
        assert ids.texts(texts) == list(map(whole, texts))


def test_a_piece_the_library_divides_is_not_known(monkeypatch):
    tok = token_count.tokenizer("word_bpe_49k.json")
    ids = packing.WordIds(tok)
    ids._learn(["plain", "a-b", "words"])  # not a piece of the vocabulary's own
    assert ids["a-b"] is None and ids["plain"] and ids["words"]
    assert ids._ids("plain a-b", ["plain", "a-b"]) == ids.library("plain a-b")


def test_packing_repeated_null_ids(spark):
    rows = [(None, "one two", "en", "", 1), (None, "one two", "en", "", 1), (None, None, None, None, None)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.length for r in out) == [1, 3, 3] and {r.sequence_id for r in out} == {out[0].sequence_id}


def test_other_operators_tasks_free_what_packing_keeps():
    from treeline.llm import common

    packing.word_ids("word_bpe_49k.json").texts(["some words"])
    list(common.tidy(iter, "packing")([]))
    assert packing._WORD_IDS
    list(common.tidy(iter)([]))
    assert not packing._WORD_IDS
    assert packing.word_ids("word_bpe_49k.json").texts(["some words"])[0]


def test_packing_encodes_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "PART_CHARS", 50)
    monkeypatch.setattr(packing, "LEARNED", 7)
    tok = token_count.tokenizer("word_bpe_49k.json")
    draw = random.Random(4)
    words = ["it's", "Don'T", "naïve", "É", "e\u0301", "Ⱥ!", "12", "a" * 300, "<|endoftext|>", "日本", "--", "\u0301x", "ΑΣ"]
    texts = ["", " " * 200, "b" * 500]
    texts += ["".join(draw.choice(words) + draw.choice([" ", "\n", "\t\r ", "\u00a0", ""]) for _ in range(draw.randrange(60))) for _ in range(200)]
    assert max(len(list(packing.parts(t))) for t in texts) > 5
    assert all("".join(packing.parts(t)) == t for t in texts)
    found = packing.WordIds(tok, draw.choice([5, 1000])).texts(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
