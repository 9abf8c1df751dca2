import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from marginflow.llm import linededup, simhash
from marginflow.llm.queries import OP6_SQL


def duck(rows):
    import pyarrow as pa

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    return sorted(con.execute(OP6_SQL).fetchall())


def ours(spark, rows):
    from pyspark.sql import functions as F

    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return sorted(tuple(r) for r in out.select("doc_id", n.alias("n_lines"), "n_deleted", F.md5("text_clean")).collect())


def test_lines_against_sql(spark):
    r = random.Random(0)
    lines = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(1, 14))) for _ in range(25)] + ["", "  "]
    for k in range(4):
        # with k, sentences in a line; at last, few long documents of many units
        joins = ["\n"] if not k else ["\n", ". ", ". ", ", ", ", ", "! ", "。"]
        rows = [(i, "".join(r.choice(lines) + r.choice(joins) for _ in range(r.randint(1, 12) if k < 3 else 300))) for i in range(40 if k < 3 else 8)]
        rows = [(i, t[:-1] if i % 2 else t) for i, t in rows]
        assert ours(spark, rows) == duck(rows)


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"


def test_lines_keep_the_first_copy(spark):
    rows = [(1, f"x\n{LONG}\ny"), (2, f"p\n\n{LONG} \nq"), (3, f"{LONG}\n{LONG}"), (4, None), (5, ""), (6, "x\ny"), (None, f"{LONG}\nz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS n_deleted", "1 AS d", "2 AS h")
    got = {r.doc_id: (r.text_clean, r.n_deleted) for r in linededup.dedup_lines(docs).collect()}
    # a null id comes first in order
    assert got == {None: (f"{LONG}\nz", 0), 1: ("x\ny", 1), 2: ("p\n\nq", 1), 3: ("", 2), 4: (None, 0), 5: ("", 0), 6: ("x\ny", 0)}
    inplace = linededup.dedup_lines(docs, out="text")
    assert "text_clean" not in inplace.columns and {r.doc_id: r.text for r in inplace.collect()}[1] == "x\ny"
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_matches_are_extended_both_ways(spark):
    a = ["short a", LONG, "short b", "short c"]
    rows = [(1, "\n".join(["own 1", *a, "own 2"])), (2, "\n".join(["own 3", *a, "own 4"]))]
    got = {r.doc_id: r.text_clean for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "own 3\nown 4"}


def test_repeats_within_a_document_and_repeated_rows(spark):
    rows = [(1, "\n".join([LONG] * 30)), (2, "a\n" + LONG), (2, "a\n" + LONG)]
    out = [(r.doc_id, r.text_clean, r.n_deleted) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(out) == [(1, LONG, 29), (2, "a", 1), (2, "a", 1)]


def test_guarantee(spark):
    """Any run of 16 words or more that occurs in an earlier document loses at least a gram."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows, shared = [], []
    for k in range(30):
        run = [" ".join(word() for _ in range(r.randint(1, 6))) for _ in range(20)]
        cut = []
        while sum(len(x.split()) for x in cut) < 16:
            cut.append(run[len(cut)])
        rows += [(2 * k, "\n".join([word(), *cut, word()])), (2 * k + 1, "\n".join([word(), word(), *cut, word()]))]
        shared.append((2 * k + 1, len(cut)))
    got = {x.doc_id: x.n_deleted for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == n for i, n in shared) and all(got[2 * k] == 0 for k in range(30))


def cleaned(spark, rows, kind="long", **options):
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    return {r.doc_id: r.text_clean for r in linededup.dedup_lines(docs, **options).collect()}


def test_tails(spark):
    """A line of 8 words or more is found at the end of any document, however short."""
    line = "one two three four five six seven eight nine"
    rows = [(1, f"top\n{line}\n{LONG}"), (2, f"{LONG} own a\n{line}"), (3, line), (4, f"own b\n{line}\n"), (5, "one two three four"), (6, "one two three four")]
    assert cleaned(spark, rows) == {1: rows[0][1], 2: f"{LONG} own a", 3: "", 4: "own b\n", 5: rows[4][1], 6: rows[5][1]}


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n)) + "."


def test_passages_within_lines(spark):
    """Passages of over 50 words in the middle of lines, cut in at any word, in the same place of no two documents."""
    r = random.Random(5)
    rows, passages = [], []
    for k in range(12):
        passage = " ".join(sentence(r, r.randint(5, 11)) for _ in range(8))[:-1]
        passages.append(passage.split())
        for i in range(4):
            around = [" ".join(sentence(r, r.randint(4, 12)) for _ in range(6)).split() for _ in range(2)]
            at, to = r.randint(3, 30), r.randint(3, 30)
            rows.append((4 * k + i, " ".join(around[0][:at] + passages[-1] + around[1][to:])))
    got = cleaned(spark, rows)
    for k, passage in enumerate(passages):
        inner = " ".join(passage[12:-12])
        assert got[4 * k] == rows[4 * k][1]
        for i in range(1, 4):
            # all but the sentences that the passage is cut in
            lost = len(rows[4 * k + i][1].split()) - len(got[4 * k + i].split())
            assert inner not in got[4 * k + i] and len(passage) - 24 <= lost <= len(passage)
    assert cleaned(spark, [(i, sentence(r, 60)) for i in range(5)])[3].count(" ") == 59


def test_passages_of_one_long_sentence(spark):
    """A passage without a sentence's end is found by its parts between commas."""
    r = random.Random(9)
    passage = ", ".join(sentence(r, 7)[:-1] for _ in range(9))
    rows = [(i, f"{sentence(r, 20)[:-1]} {passage} {sentence(r, 20)} {sentence(r, 9)}") for i in range(3)]
    got = cleaned(spark, rows)
    assert got[0] == rows[0][1] and all(passage[80:-80] not in got[i] and len(got[i].split()) < 66 for i in (1, 2))
    assert ours(spark, rows) == duck(rows)


def test_what_stays_of_lines(spark):
    """Line feeds of lines that stay in part stay, those of whole lines go; short runs within lines stay."""
    a, b, c, d = ("Aa bb cc dd ee ff gg hh ii jj kk.", "Ba bb cc dd ee ff gg hh ii jj kk!", "Ca bb cc dd ee ff gg hh ii jj kk?", "Da bb cc dd ee ff gg hh ii jj kk.")
    rows = [(1, f"{a} {b} {c}\n{d}"), (2, f"x y. {a} {b} {c}\nz"), (3, f"x\n{a} {b} {c} y z.\nz"), (4, f"w. {b} {c}\n{d} v\n\nu"), (5, f"one. {b} two."), (6, f"{d}\nend"), (7, f"q. {a} {b} {c}\n{d} r."), (8, f"k\n{d}")]
    assert cleaned(spark, rows) == {1: rows[0][1], 2: "x y. \nz", 3: "x\ny z.\nz", 4: "w. \nv\n\nu", 5: rows[4][1], 6: "end", 7: "q. \nr.", 8: "k"}
    assert ours(spark, rows) == duck(rows)


def test_ids_of_any_type(spark):
    rows = [("b", f"x\n{LONG}"), ("a", LONG), (None, f"{LONG}\ny"), ("a", LONG)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert Counter((r.doc_id, r.text_clean) for r in got) == Counter([("b", "x"), ("a", ""), ("a", ""), (None, f"{LONG}\ny")])


def test_a_mark_in_the_text_is_kept(spark):
    rows = [(1, LONG), (2, f"a\ufdd0b\n{LONG}\nc. d")]
    assert cleaned(spark, rows) == {1: LONG, 2: "a\ufdd0b\nc. d"}


def test_copies_are_spared(spark):
    """With spare a document that is mostly repeated stays whole, for the near-duplicate stage."""
    r = random.Random(6)
    text = "\n".join(sentence(r, 12) for _ in range(10))
    rows = [(1, text), (2, text), (3, text.replace(" ", " x ", 1)), (4, text[: len(text) // 2] + "\n" + "\n".join(sentence(r, 12) for _ in range(10)))]
    got = cleaned(spark, rows, spare=0.6)
    assert [got[i] for i in (1, 2, 3)] == [rows[i][1] for i in range(3)] and len(got[4]) < len(rows[3][1]) * 0.8
    stage = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0L AS n_chars"), "").collect()}
    assert stage == got


def test_trimmed_pieces(spark):
    """The quick way for pieces without odd blanks gives what trimming by the list gives; units have no text copied."""
    from pyspark.sql import functions as F

    r = random.Random(11)
    texts = ["", " ", "\n", "a", "a. ", " a", "a\t ", "a \x0b", "\x01a ", "a\x01", "\u3000a\u3000", "é ", "。", "a\xa0 ", "!", " !\r\n"]
    texts += ["".join(r.choice("ab.é。 \t\r\f\x0b\n\x1f!") for _ in range(r.randint(1, 7))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", linededup._trimmed(F.col("x")).alias("y")).collect()
    assert all(row.y == row.x.strip(linededup.BLANKS) for row in got) and len(got) == len(texts)
    units = spark.createDataFrame([(texts,)], "p array<string>").select(linededup._units(F.col("p")).alias("u")).first().u
    assert units.asDict().keys() == {"at", "nl"} and units["at"] == [i for i, t in enumerate(texts) if t.strip(linededup.BLANKS)]
    assert units["nl"] == [i == 0 or texts[i - 1].endswith("\n") for i in units["at"]]


def test_native():
    source = open(linededup.__file__).read()
    assert "pandas" not in source and "udf" not in source and "mapIn" not in source and "rdd" not in source


# SimHash


def fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    n, root = len(fps), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint(spark):
    texts = [None, "", " \t\n", "one", "Two words", "a b c d", "A b C d e é É", "x\x0by\x0cz w v", "word " * 3000]
    assert [simhash.fingerprint(t) for t in texts] == [fp(t) for t in texts]
    df = spark.sql("SELECT xxhash64('a b c d') AS h").first()
    assert df.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42) == simhash.fingerprint("a b c d")


def test_masks_cover():
    m = [x & (2**64 - 1) for x in simhash.masks()]
    r = random.Random(0)
    assert len(m) == 31 and all(28 <= x.bit_count() <= 36 for x in m)
    for _ in range(5000):
        d = sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
        assert any(d & x == 0 for x in m)


@pytest.mark.parametrize("tile", [512, 3])
def test_near_duplicates_against_brute_force(spark, tile):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = set()
    for b in base:
        for _ in range(20):
            b ^= sum(1 << k for k in r.sample(range(64), r.randint(0, 6)))
            fps.add(b)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.fp: r.component for r in simhash.near_components(nodes, tile=tile).collect()}
    want = brute_components(fps)
    named = {}
    for i, x in enumerate(signed):
        named.setdefault(want[i], set()).add(got.get(x, x))
    assert all(len(v) == 1 for v in named.values()) and len(set.union(*named.values())) == len(named)
    alone = {x for i, x in enumerate(signed) if want.count(want[i]) == 1}
    assert not alone & set(got)


def test_forest_of_a_dense_group_is_small():
    r = np.random.default_rng(0)
    fps = np.array(sorted({int(x) for x in (1 << r.integers(0, 62, 400)) | (1 << r.integers(0, 62, 400))}), np.int64)
    links = simhash.forest(fps, 4)  # rows of fps
    assert len(links) == len(fps) - 1


def test_documents(spark):
    words = " ".join(f"w{i}" for i in range(400))
    rows = [(5, words), (3, words), (8, words.replace("w7 ", "w7x ")), (1, "something else entirely, and more of it"), (9, None), (7, ""), (None, words), (3, words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS fp", "0 AS component")
    got = simhash.near_duplicates(docs).collect()
    fps = [fp(t) for _, t in rows]
    comp = brute_components(fps)
    least = {c: min(i for (i, _), k in zip(rows, comp) if k == c and i is not None) for c in set(comp)}
    want = Counter((i, f, least[c]) for (i, _), f, c in zip(rows, fps, comp))
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def edited(r, text, share):
    words = text.split()
    for i in r.sample(range(len(words)), int(share * len(words))):
        words[i] = sentence(r, 1)
    return " ".join(words)


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_texts_by_five_word_shingles(spark):
    """Recall of pairs with a similarity of 0.8 or more over 0.9; texts below 0.6, and others, are left alone."""
    r = random.Random(7)
    vocabulary = [sentence(r, 1)[:-1] for _ in range(3000)]
    rows, close = [], 0
    for k in range(120):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randint(150, 600)))
        rows.append((10 * k, text))
        rows.append((10 * k + 1, edited(r, text, 0.02 if k < 90 else 0.09)))
    rows += [(5000, rows[0][1]), (None, None), (5001, ""), (5002, rows[0][1])]
    got = {x.doc_id: x.component_id for x in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5000] == got[5002] == 0 and got[5001] == 5001 and got[None] == 5001
    hits = [got[10 * k + 1] == 10 * k for k in range(120) if jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8]
    far = [got[10 * k + 1] == 10 * k + 1 for k in range(120) if jaccard(rows[2 * k][1], rows[2 * k + 1][1]) < 0.6]
    assert len(hits) > 60 and sum(hits) >= 0.9 * len(hits) and len(far) > 20 and all(far)
    assert simhash.near_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_group_of_near_texts(spark):
    """A large group of near copies is one component, with small tiles too."""
    r = random.Random(8)
    text = " ".join(sentence(r, 1)[:-1] for _ in range(400))
    rows = [(i, edited(r, text, 0.008)) for i in range(300)] + [(1000 + i, sentence(r, 200)) for i in range(50)]
    got = {x.doc_id: x.component_id for x in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(300)} == {0} and all(got[1000 + i] == 1000 + i for i in range(50))
