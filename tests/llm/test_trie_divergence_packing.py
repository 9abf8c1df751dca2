import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginflow.llm import divergence, packing, trie
from marginflow.llm.common import running
from marginflow.llm.queries import tokenizer_path

PATH = tokenizer_path()


def test_running(spark):
    r = random.Random(3)
    rows = [(r.randrange(50), r.choice([None, 1, 2, -5]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, x long, i long").repartition(5)
    out = running(df, [F.col("k"), F.col("i")], {"s": "x"}, rank="at").collect()
    total = 0
    for at, (k, x, i) in enumerate(sorted(rows, key=lambda v: (v[0], v[2]))):
        total += x or 0
        got = next(o for o in out if o.i == i)
        assert (got.at, got.s) == (at, total)
    assert running(df.where("k < 0"), [F.col("i")], {"s": "x"}, rank="at").count() == 0


# trie


def brute_trie(rows):
    """(conv_id, turn, role, text) rows to the nodes of the contract, by sets of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(xs, key=lambda x: (x[0], x[1], x[2], x[3][:64], hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).hexdigest()))] for c, xs in own.items()}
    paths = {}
    for c, xs in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        paths[c] = tuple(own.get(base, [])[:h]) + tuple(xs[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids = Counter(n[:-1] for n in members if n)
    out = []
    for n, cs in members.items():
        below = [m for m in members if m[: len(n)] == n]
        ends = sorted(c for c in cs if paths[c] == n)
        out.append((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), kids[n], sum(kids[m] == 0 for m in below), sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes_of(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed, convs, most=9, texts=("a", "bb", "c", "")):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 420), convs):
        rows += [(c, t if r.random() < 0.9 else None, r.choice(["user", "bot", None]), r.choice([*texts, None])) for t in range(r.randrange(1, most))]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(trie, "STRETCH", 3)
    rows = conversations(seed, 60)
    rows += [(None, 1, "user", "no conversation")] * 2 + rows[:7]  # null ids, repeated rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = trie.prefix_trie(df.withColumn("depth", F.lit(7)).withColumn("n", F.lit("x")))
    assert nodes_of(got) == brute_trie(rows)
    # the interval of a subtree holds as many nodes as lie below its top
    spans = {(r.conv_id, r.depth): (r.first, r.last) for r in got.collect()}
    assert sorted(a for a, _ in spans.values()) == list(range(len(spans)))
    assert all(a <= b for a, b in spans.values()) and spans[min(c for c, d in spans if d == 0), 0] == (0, len(spans) - 1)


def test_trie_of_copies_and_a_long_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 900) for t in range(3)] + [(1001, t, "user", "x" * 5000 if t == 700 else f"turn {t % 7}") for t in range(1500)]
    rows += [(1002, t, "user", f"turn {t % 7}") for t in range(650)]
    got = nodes_of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert len(got) > 2000 and got == brute_trie_long(rows)


def brute_trie_long(rows):
    """As ``brute_trie``, by a walk over a trie of nested dictionaries."""
    own = {}
    for c, t, role, text in rows:
        own.setdefault(c, []).append((t, role, text))
    own = {c: [(b, x) for _, b, x in sorted(v)] for c, v in own.items()}
    root = {"m": [], "e": [], "k": {}, "t": None}
    for c, xs in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        node = root
        node["m"].append(c)
        for turn in own.get(c - c % 100, [])[:h] + xs[h:]:
            node = node["k"].setdefault(turn, {"m": [], "e": [], "k": {}, "t": turn[1]})
            node["m"].append(c)
        node["e"].append(c)
    order, stack = [], [(root, 0, None)]
    while stack:
        node, d, up = stack.pop()
        order.append((node, d, up))
        stack += [(k, d + 1, node) for k in node["k"].values()]
    for node, _, _ in reversed(order):
        node["leaves"] = sum(k["leaves"] for k in node["k"].values()) or (not node["k"])
        node["saved"] = sum(k["saved"] for k in node["k"].values()) + (len(node["m"]) - 1) * len(node["t"] or "")
    return sorted(((min(n["m"]), d, min(up["m"]) if up else None, len(n["m"]), len(n["k"]), int(n["leaves"]), n["saved"], hashlib.sha256(",".join(map(str, sorted(n["e"]))).encode()).hexdigest()) for n, d, up in order), key=repr)


def test_trie_of_odd_tables(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "t")], SCHEMA)).count() == 0
    # no base and a turn that is cut away: a turnless conversation, member of the root only
    lone = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 0)
    assert nodes_of(trie.prefix_trie(spark.createDataFrame([(lone, 0, "u", "t")], SCHEMA))) == brute_trie([(lone, 0, "u", "t")])
    odd = [(200, None, None, None), (200, None, None, None), (201, 3, "u", "é" * 70 + "x"), (201, 3, "u", "é" * 70 + "y"), (202, 1, "", "")]
    assert nodes_of(trie.prefix_trie(spark.createDataFrame(odd, SCHEMA))) == brute_trie(odd)


# divergence


def brute_divergence(rows, least=3, k=200):
    """(lang, source, text) rows by the definitions, every term of every group."""
    docs = [(a or "", b or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", c or "")]) for a, b, c in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, ts in mine:
            counts[s].update(t for t in ts if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, k)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i + 1) for i, (t, v) in enumerate(items[:most])]
    return sorted(out)


def said(r, words, n):
    return "".join(r.choice(words) + r.choice([" ", ", ", "\n", "4", "-"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(2))
def test_divergence_against_brute_force(spark, monkeypatch, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdXYZéß語") for _ in range(r.randint(1, 4))) for _ in range(150)]
    rows = [(r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s2", "s3", None]), said(r, words[: r.randint(2, 150)], r.randrange(60))) for _ in range(150)]
    rows += [("en", "empty", ""), ("en", "empty", None), ("xx", "a", "once only"), ("xx", "b", "never more")] + rows[:5]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3).withColumn("term", F.lit(1)).withColumn("value", F.lit("x"))
    for k in (200, 3):
        got = sorted(map(tuple, divergence.source_divergence(df, k=k).collect()))
        assert got == brute_divergence(rows, k=k)


def test_divergence_of_odd_tables(spark):
    schema = "lang string, source string, text string"
    assert divergence.source_divergence(spark.createDataFrame([], schema)).count() == 0
    long = [("en", "s", "word " * 200_000 + "other"), ("en", "t", "word other"), ("en", "t", "other WORD")]
    got = sorted(map(tuple, divergence.source_divergence(spark.createDataFrame(long, schema)).collect()))
    assert got == brute_divergence(long)


def test_search_evaluates_few_buckets(spark):
    """Buckets whose bound is below the k-th score are not evaluated, and one that only ties with it is."""
    rows = [("en", "s", f"t{i}", c, c, 10, 100 + i) for i, c in enumerate([5, 5, 3, 3, 1])]
    entries = spark.createDataFrame([(a, t, s, c, 1, 10**6 * c, 10**5 + i) for i, (a, s, t, c, *_) in enumerate(rows)], "lang string, term string, source string, c long, p0 long, p long, q long")
    top = divergence.top_terms(entries, 2).collect()
    assert [(r.item, r["rank"]) for r in sorted(top, key=lambda r: r["rank"])] == [("t0", 1), ("t1", 2)]
    tie = spark.createDataFrame([("en", "b", "s", 2, 1, 400, 100), ("en", "a", "s", 1, 1, 400, 100)], entries.schema)
    assert [(r.item, r.value) for r in divergence.top_terms(tie, 1).collect()] == [("a", 900)]


# packing


def cost_of(at, price, cuts, length):
    total, begin = 0, at[0]
    for j in cuts:
        n = at[j] - begin
        assert 0 < n <= length
        total += (0 if n & (n - 1) == 0 else length - n) + price[j]
        begin = at[j]
    return total


def test_best_cuts_are_the_cheapest():
    r = random.Random(4)
    for _ in range(150):
        length = r.choice([8, 16, 64])
        at = [0]
        for _ in range(r.randrange(1, 40)):
            at.append(at[-1] + r.randint(1, max(1, length // 3)))
        price = [0, *(r.choice([0, 2, 7]) + 1 for _ in at[1:])]
        best = [0.0] + [float("inf")] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                n = at[j] - at[i]
                if n <= length:
                    best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else length - n) + price[j])
        cuts = packing.best_cuts(at, price, length)
        assert cuts[-1] == len(at) - 1 and cost_of(at, price, cuts, length) == best[-1]


def test_crc_of_rest():
    r = random.Random(5)
    for _ in range(60):
        a, n = r.randbytes(4 * r.randrange(0, 50)), r.randrange(0, 2049)
        b = r.randbytes(4 * n)
        assert int(packing.crc_of_rest([zlib.crc32(a + b)], [zlib.crc32(a)], [n])[0]) == zlib.crc32(b)


def test_words_merged_at_once_are_the_librarys():
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    encoder = packing._encoder(PATH)
    r = random.Random(6)
    texts = ["", None, "One. Two! <|endoftext|> three? \n\n x", "the" * 9000, "日本語。テスト", " ".join("".join(r.choice("abcdeinthrs.") for _ in range(r.randint(1, 30))) for _ in range(3000))]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids if text else []
        for sentences in (encoder.sentences(text), encoder.sentences(text, encoder.read([text])[0])):
            assert array("I", b"".join(b for b, _ in sentences)).tolist() == want


def test_ranks_of_pairs():
    """Looked up in the table of hashes as in the list of merges, pairs without a merge and without an id included."""
    import numpy as np

    encoder = packing._encoder(PATH)
    r, ranks = random.Random(8), encoder.table.ranks
    pairs = [*ranks, *((r.randrange(-1, 49_000), r.randrange(-1, 49_000)) for _ in range(100_000))]
    x, y = np.array(pairs[: len(pairs) // 2 * 2], np.int32).reshape(-1, 2, 2).transpose(2, 0, 1)
    got = encoder.merger.rank(x, y)
    assert got.shape == x.shape and got.ravel().tolist() == [ranks.get(p, encoder.merger.none) for p in zip(x.ravel().tolist(), y.ravel().tolist())]


def check_packing(rows, docs, length=2048):
    """Pieces, checked against the library's ids."""
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    ids = {i: [*(library.encode(t, add_special_tokens=False).ids if t else []), 1] for i, t in docs}
    at = {i: 0 for i in ids}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert r.start == at[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(array("I", piece).tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
    assert all(at[i] == len(x) for i, x in ids.items())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    order = []
    for key in sorted(sequences):
        n = 0
        for r in sorted(sequences[key], key=lambda r: r.offset):
            assert r.offset == n
            n += r.length
            order.append((r.doc_id is not None, r.doc_id or 0, r.start))
        assert n <= length and {r.padding for r in sequences[key]} == {0 if n & (n - 1) == 0 else length - n}
    assert order == sorted(order)
    return sum(s[0].padding for s in sequences.values()) / sum(map(len, ids.values()))


def test_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = packing.pack(docs.withColumn("length", F.lit("x")).withColumn("block", F.lit(1)), PATH).collect()
    assert check_packing(rows, [tuple(r) for r in docs.collect()]) < 0.01
    # most cuts within documents are at the ends of sentences
    cut = [r for r in rows if r.start + r.length < r.doc_tokens]
    assert cut


def test_packing_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), PATH).count() == 0
    r = random.Random(7)
    docs = [(None, "no id. here"), (1, None), (2, ""), (3, "a" * 30_000), (4, "word " * 70_000), (5, "x. " * 5000), (6, " \n"), (7, "tail")]
    docs += [(10 + i, " ".join(r.choice(["one", "two.", "three!"]) for _ in range(r.randrange(400)))) for i in range(60)]
    df = spark.createDataFrame(docs, schema).repartition(4)
    check_packing(packing.pack(df, PATH, block=5000).collect(), docs)
    check_packing(packing.pack(df, PATH, length=32, block=3000).collect(), docs, 32)
    # rows of one id are documents of their own
    same = packing.pack(spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "x")], schema), PATH).collect()
    assert sorted((x.start, x.length, x.doc_tokens) for x in same) == [(0, 2, 2), (0, 3, 3), (0, 3, 3)]
    with pytest.raises(ValueError):
        packing.pack(df, PATH, length=4)
