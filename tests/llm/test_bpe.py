import hashlib
import json
import random
import sys
from array import array

import pytest
from tokenizers import Tokenizer

from marginflow.llm import bpe
from marginflow.llm.queries import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def table():
    return bpe.MergeTable(PATH)


def texts():
    r = random.Random(0)
    ranges = [*range(32, 127), *range(0xA0, 0x250), *range(0x370, 0x400), *range(0x2000, 0x2070), *range(0x300, 0x330)]
    yield from ["", " \n\t", "a<|endoftext|>b <|startoftext|>", "Straße ΑΣ ΣΑΣ İstanbul ﬁ é ́x \x1cq\x1d \x85 z", "it's we'll I'd 've 123 ½ ²x a'S don'T", "日本語 🙂🙂 नमस्ते", "x" + "́" * 50, "￾﻿　 x"]
    yield "".join(r.choice("abcdeinthrs") for _ in range(20000))
    yield "the" * 6000
    yield "a" * 9001
    yield "!" * 6000
    for _ in range(200):
        yield "".join(chr(r.choice(ranges)) for _ in range(120))


def test_ids_and_text_are_the_librarys(library, table):
    encoder, decoder = bpe.Encoder(table), bpe.Decoder(table)
    for text in texts():
        blocks = list(encoder.encode(text))
        want = library.encode(text, add_special_tokens=False).ids
        assert array("I", b"".join(blocks)).tolist() == want, text[:80]
        assert b"".join(decoder.decode(blocks)).decode() == library.decode(want, skip_special_tokens=False)


def test_pieces_do_not_matter(table, monkeypatch):
    whole = [b"".join(bpe.Encoder(table).encode(t)) for t in texts()]
    monkeypatch.setattr(bpe, "PIECE_CHARS", 7)
    monkeypatch.setattr(bpe, "MEMO_BYTES", 1000)
    assert [b"".join(bpe.Encoder(table).encode(t)) for t in texts()] == whole


def test_stream_emits_early_and_keeps_little(table):
    """Tokens leave the transducer before the word ends, and equal those of the whole word."""
    r = random.Random(1)
    symbols = [table.inner[b] for b in "".join(r.choice("inthe") for _ in range(30000)).encode()]
    read = 0

    def feed():
        nonlocal read
        for s in symbols:
            read += 1
            yield s

    out, waiting, done = [], 0, 0
    for token in table.stream(feed()):
        out.append(token)
        done += len(table.tokens[token])
        waiting = max(waiting, read - done)
    assert out == table.merge(symbols) and waiting <= table.lookahead + max(table.width) + bpe.STEP


def test_lookahead_of_a_small_list(tmp_path):
    """ab, then bc made first: whether a joins b depends on the c after it."""
    spec = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4}, "merges": ["b c", "a b"]}, "pre_tokenizer": {"type": "Split", "pattern": {"Regex": "\\w+"}, "behavior": "Removed", "invert": True}}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    t = bpe.MergeTable(str(tmp_path / "t.json"))
    assert t.lookahead == 2 and t.far[t.vocab["a"]] == 2 and t.far[t.vocab["b"]] == 1 and t.far[t.vocab["bc"]] == 0
    assert t.merge([0, 1, 2]) == [0, 3] and t.merge([0, 1]) == [4]


def test_stream_of_random_merge_lists(tmp_path):
    """Whatever the list, looking after each symbol gives the tokens of the whole word, many of them before its end."""
    r = random.Random(4)
    early = 0
    for k in range(60):
        tokens, merges = list("abc"), []
        while len(merges) < 25:
            x, y = r.choice(tokens), r.choice(tokens)
            if len(x + y) <= 8 and (x, y) not in merges:
                merges.append((x, y))
                tokens += [x + y] * (x + y not in tokens)
        spec = {"model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": [" ".join(m) for m in merges]}, "pre_tokenizer": {"type": "Split", "pattern": {"Regex": "\\w+"}, "behavior": "Removed", "invert": True}}
        (tmp_path / f"{k}.json").write_text(json.dumps(spec))
        t = bpe.MergeTable(str(tmp_path / f"{k}.json"))
        for _ in range(40):
            word, read = [r.randrange(3) for _ in range(r.randint(1, 60))], 0

            def feed():
                nonlocal read
                for read, s in enumerate(word, 1):
                    yield s

            got, before = [], 0
            for x in t.stream(feed(), 1):
                got.append(x)
                before += read < len(word)
            assert got == t.merge(word), (merges, word)
            early += before
    assert early > 5000


def test_documents_run_through_the_transducer(table):
    """Words of the given documents give tokens before they end."""
    import pyarrow.parquet as pq

    texts = [x for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if x]
    words = {w for t in texts for w in table.pattern.findall(t.lower()) if len(w.encode()) > bpe.STEP}
    early = 0
    for w in words:
        symbols, read = list(table.symbols(w)), 0

        def feed():
            nonlocal read
            for read, s in enumerate(symbols, 1):
                yield s

        got = []
        for x in table.stream(feed()):
            got.append(x)
            early += read < len(symbols)
        assert got == table.merge(symbols)
    assert words and early > len(words) / 2


def test_memory_is_bounded(table):
    """Two million characters without white space, and many different words: little is held beside the text."""
    import tracemalloc

    r = random.Random(2)
    text = "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(2_000_000))
    chunks = [text[i : i + 250] for i in range(0, 500_000, 250)] * 20
    encoder = bpe.Encoder(table)
    tracemalloc.start()
    blocks = sum(len(b) for b in encoder.encode(text))
    long = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert blocks > 4_000_000 and long < 24 * len(text)
    old, bpe.MEMO_BYTES = bpe.MEMO_BYTES, 1 << 20
    try:
        encoder = bpe.Encoder(table)
        for c in chunks[:2000]:
            b"".join(encoder.encode(c))
        held = sum(sys.getsizeof(k) + sys.getsizeof(v) for m in (encoder.memo, encoder.old) for k, v in m.items())
    finally:
        bpe.MEMO_BYTES = old
    assert held <= 1 << 20


def test_byte_level_round_trip():
    """A tokenizer that keeps white space, with a byte-level decoder, through the UTF-8 state machine."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, table = Tokenizer.from_file(path), bpe.MergeTable(path)
    encoder, decoder = bpe.Encoder(table), bpe.Decoder(table)
    for text in ["", "Hello  world\n\n  x 12ab", "日本語 🙂 naïve\tend ", "a<|endoftext|> b"]:
        blocks = list(encoder.encode(text))
        ids = array("I", b"".join(blocks)).tolist()
        assert ids == lib.encode(text, add_special_tokens=False).ids
        one_by_one = [array("I", [i]).tobytes() for i in ids]
        assert b"".join(decoder.decode(one_by_one)).decode() == text


def test_documents(spark, library):
    rows = [(1, "The cat's hat."), (2, None), (3, ""), (3, ""), (None, "x"), (4, "word " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS n_tokens", "1 AS extra")
    out = bpe.encode_documents(docs, PATH, ids=True).collect()
    assert len(out) == 6
    for r, (i, text) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0]))):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert r.doc_id == i and r.n_tokens == len(want) and r.token_ids == want
        assert r.ids_sha256 == hashlib.sha256(array("I", want).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_documents(docs, PATH, keep=("doc_id", "n_tokens"))
