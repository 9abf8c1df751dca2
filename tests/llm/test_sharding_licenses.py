import re
import zlib
from collections import Counter

import pytest

from marginflow.llm import licenses, sharding


def test_sharding(spark):
    rows = [(i, "é" * (i % 5)) for i in range(3000)] + [(7, "x"), (7, "x"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 AS shard", "1 AS slot")
    out = sharding.assign(docs, [1.0] * 8).collect()
    assert len(out) == len(rows)
    texts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == texts
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 8) for r in out)
    assert {r.shard for r in out if r.doc_id == 7} and len({r.shard for r in out if r.doc_id == 7}) == 1
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) < 1.3 * min(sizes.values())
    assert 0.06 < sum(r.grown_shard == 8 for r in out) / len(out) < 0.17
    assert sharding.assign(docs.limit(0), [1.0]).count() == 0


def test_weights(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'' AS text")
    n = Counter(r.shard for r in sharding.assign(docs, [1.0, 3.0]).collect())
    assert 0.72 < n[1] / 20000 < 0.78
    before = {r.doc_id: r.shard for r in sharding.assign(docs, [1.0, 1.0, 1.0]).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign(docs, [1.0, 1.0, 2.0]).collect()}
    assert all(after[d] in (before[d], 2) for d in before)
    with pytest.raises(ValueError):
        sharding.assign(docs, [1.0, 0.0])


def test_shards_by_the_definition(spark):
    """Each key's shard by hashing key and shard, one after the other, with the xxhash library."""
    import math
    import struct

    import xxhash

    def u(key, shard):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        return ((xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 11) + 0.5) / 2**53

    for weights in ([1.0] * 8, [1.0, 2.5, 0.5]):
        docs = spark.createDataFrame([(i,) for i in [*range(500), None, -7, 2**60]], "doc_id long").selectExpr("doc_id", "'x' AS text")
        for r in sharding.assign(docs, weights).collect():
            grown = [*weights, sum(weights) / len(weights)]
            for w, got in ((weights, r.shard), (grown, r.grown_shard)):
                scores = [x / -math.log(u(r.doc_id, s)) for s, x in enumerate(w)]
                assert got == scores.index(max(scores))


def brute(text):
    """Every line against every template, without bounds or tests of words."""
    out = []
    for n, line in enumerate((text or "").split("\n") if text is not None else []):
        w = re.sub(r"[^\w]|_", " ", line.lower()).split()
        own = {f"{a} {b}" for a, b in zip(w, w[1:])}
        best = None
        rank = 0
        for name in sorted(licenses.TEMPLATES):
            for t in licenses.TEMPLATES[name]:
                b = set(licenses.bigrams_of(t))
                d = 2 * len(own & b) / (len(own) + len(b)) if own else 0
                if 2 * len(own & b) >= 0.8 * (len(own) + len(b)) and (best is None or d > best[0]):
                    best = (d, name)
                rank += 1
        if best:
            out.append((n, best[1], round(best[0], 9)))
    return out


def test_licenses(spark):
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts]
    texts = [n for n in notices] + [n.upper() + " indeed" for n in notices] + [" ".join(n.split()[1:]) for n in notices] + [f"prose\n\n{a}\n{b}" for a, b in zip(notices, notices[3:])]
    texts += [None, "", "\n\n", "license", "mit license", "the license " * 3000, "words about a license of some kind, and more words to come", "Released under the MIT License. " * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS license", "1 AS line2")
    got = {}
    for r in licenses.license_lines(docs).collect():
        got.setdefault(r.doc_id, []).append((r.line, r.license, round(r.dice, 9)))
    want = {i: b for i, t in enumerate(texts) if (b := brute(t))}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert all(any(n == name for _, n, d in got[i] if d == 1.0) for i, name in enumerate(n for n, ts in licenses.TEMPLATES.items() for _ in ts))


def test_license_documents(spark):
    docs = spark.createDataFrame([(1, "a\nReleased under the MIT License.\nLicensed under CC BY 4.0."), (1, "Released under the MIT License."), (2, None), (None, "Licensed under the Apache License, Version 2.0.")], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.n_lines, r.dice, r.first_line) for r in licenses.scan(docs).collect()}
    assert got == {1: ("CC-BY-4.0,MIT", 3, 1.0, 0), None: ("Apache-2.0", 1, 1.0, 0)}
    assert licenses.scan(docs.limit(0)).count() == 0
    plan = licenses.license_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    with pytest.raises(ValueError):
        licenses.scan(docs, threshold=0.0)


def test_wrapped_and_embedded_notices(spark):
    import textwrap

    mit = licenses.TEMPLATES["MIT"][3][:-1] + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    gpl = textwrap.wrap(licenses.HEADERS["GPL-3.0"][0], 70)
    texts = ["\n".join(textwrap.wrap(mit, 78)), mit, "a\n\nThe sources of this project can be found online and are released under the MIT License.", "x\n" + "\n".join("# " + x for x in gpl), "Released under the MIT License.\n" + " ".join(gpl), "a license that is released under no terms\nat all", None]
    got = {r.doc_id: (r.licenses, r.n_lines, r.dice, r.first_line) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("MIT", 1, 1.0, 0), 1: ("MIT", 1, 1.0, 0), 2: ("MIT", 1, 1.0, 2), 3: ("GPL-3.0", 1, 1.0, 1), 4: ("GPL-3.0,MIT", 2, 1.0, 0)}
    plan = licenses.license_passages(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_size_bounds():
    for n in range(1, 40):
        low, high = licenses.size_bounds(n, 0.8)
        for a in range(1, 120):
            assert (low <= a <= high) == (2 * min(a, n) >= 0.8 * (a + n))


def test_whole_texts_wrapped_and_edited(spark):
    """Recall of whole licence texts: wrapped, commented and with up to one word in 25 changed, within prose."""
    import random
    import textwrap

    r = random.Random(0)
    rows, want = [], {}
    for name, text in licenses.TEXTS.items():
        for k in range(8):
            words = text.split()
            for i in r.sample(range(len(words)), k * len(words) // 200):
                words[i] = r.choice(("", "other", f"{words[i]} too"))
            mark = r.choice(("", "# ", " * ", "// "))
            body = "\n".join(mark + x for x in textwrap.wrap(" ".join(words), r.choice((50, 72, 100))))
            doc = len(rows)
            rows.append((doc, f"Copyright (c) 2020 Some One\n\n{body}\n\nint main() {{ return 0; }}"))
            want[doc] = name
    clean = ["the software is provided in a box and any person may copy this and that from it", "warranties of merchantability are a matter of law; redistributions are not"]
    rows += [(1000 + i, t) for i, t in enumerate(clean)]
    got = {x.doc_id: (x.licenses.split(","), x.dice) for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = [want[d] in got.get(d, ([], 0))[0] for d in want]
    assert sum(hits) >= 0.95 * len(hits) and not {1000, 1001} & set(got)
    exact = [got[d][1] for d in want if d % 8 == 0]
    assert all(x == 1.0 for x in exact)
    plan = licenses.license_texts(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
