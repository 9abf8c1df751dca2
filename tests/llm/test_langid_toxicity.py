import random
import zlib

import numpy as np

from marginflow.llm import langid, toxicity
from marginflow.llm.common import read
from marginflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_codewords_differ():
    for n in (1, 2, 3, 4, 6, 7, 12, 40):
        c = langid.codewords(n)
        assert c.shape[0] == n
        distances = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
        assert not distances or min(distances) >= max(1, c.shape[1] // 4)


def test_language_accuracy(spark):
    docs = {r.doc_id: r for r in read(spark, FOLDER, "documents").collect()}
    out = QUERIES["op5_language_id"](spark, FOLDER).collect()
    assert len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98


def test_language_edges(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "12 %% 3\n!", None), (4, "the and of this that", None), (4, "the and of this that", None), (None, "der die und das", None), (6, "the and " * 200_000, None), (7, "日本", None)]
    train = [(10 + i, "the and of this that " * 3, "en") for i in range(20)] + [(50 + i, "der die und das nicht " * 3, "de") for i in range(20)]
    docs = spark.createDataFrame(rows + train, "doc_id long, text string, lang string").selectExpr("*", "1 AS n")
    model = langid.fit(docs)
    assert model.langs == ["de", "en"]
    got = {}
    for r in langid.predict(docs, model).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert [got[i][0][0] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i][0][1] == 0 for i in (1, 2, 3))
    assert [x[0] for x in got[4]] == ["en", "en"] and got[None][0][0] == "de" and got[6][0][0] == "en"
    assert got[7][0][0] in ("de", "en")
    nothing = langid.fit(docs.where("lang IS NULL"))
    assert nothing.langs == [] and {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(docs.where("doc_id = 4"), one).collect()} == {"en"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_long_texts_count_whole():
    model = langid.Model(["a", "b"], langid.codewords(2), np.random.default_rng(0).normal(size=(1, langid.BUCKETS)).astype(np.float32), np.ones(1))
    text = langid.cleaned("lorem ipsum dolor " * 500_000)
    a = model.outputs([text])
    old, langid.BLOCK = langid.BLOCK, 1 << 30
    try:
        b = model.outputs([text, text])
    finally:
        langid.BLOCK = old
    np.testing.assert_allclose(a[0], b[1], rtol=1e-5)


def test_fold():
    assert toxicity.fold("1D10T") == "idiot"
    assert toxicity.fold("ІdіоТ") == "idiot"
    assert toxicity.fold("scu​m") == "scum"
    assert toxicity.fold("ｍｏｒｏｎ") == "moron"
    assert toxicity.fold("$tup1d m0r0n") == "stupid moron"
    assert toxicity.fold("in 2024, 10 a.m. §5") == "in 2024, 10 a.m. §5"


def test_matching_and_exceptions():
    lex = toxicity.Lexicon({"idiot$": 3.0, "scum": 2.0, "trash$": 1.0})
    assert lex.matched("An idiot, scummy 1d1ot.")[:2] == (8.0, 3)
    assert lex.matched("idiotic patidiot")[:2] == (0.0, 0)
    assert lex.matched("take out the trash can")[:2] == (0.0, 0)
    assert lex.matched("trash canister")[:2] == (1.0, 1)
    assert lex.matched("")[:2] == (0.0, 0)
    assert toxicity.Lexicon({}).matched("idiot")[:2] == (0.0, 0)


def brute_matched(lex, text):
    """Every word against every entry."""
    total, n = 0.0, 0
    folded = toxicity.fold(text)
    import re

    for m in re.finditer(r"[^\W\d_]+", folded):
        best = max([w for e, w in lex.weights.items() if (m[0] == e[:-1] if e.endswith("$") else m[0].startswith(e))], default=0.0)
        total, n = total + best, n + (best > 0)
    return total, n


def test_matching_against_brute_force():
    r = random.Random(0)
    lex = toxicity.Lexicon({"ab$": 1.0, "abc": 2.0, "ba": 0.5, "c$": 0.25, "abcab": 4.0}, ())
    for _ in range(300):
        text = "".join(r.choice("abc -.A") for _ in range(40))
        assert lex.matched(text)[:2] == brute_matched(lex, text)


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in read(spark, "/root/testdata/sf0.1", "labels").collect()}
    out = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    hit = sum(p and t for p, t in held)
    assert hit / sum(t for _, t in held) > 0.9 and hit / sum(p for p, _ in held) > 0.85


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "fine"), (5, "fine " * 100_000)], "doc_id long, text string").selectExpr("*", "0.5 AS x")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    lex = toxicity.fit(docs, labels)
    got = [(r.doc_id, r.predicted) for r in toxicity.score_documents(docs, lex).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (3, 1), (3, 1), (None, 0), (5, 0)], key=str)
    one_kind = spark.createDataFrame([(3, 1), (1, 1), (None, 1), (5, None)], labels.schema)
    assert toxicity.fit(docs, one_kind).weights == lex.weights
    assert toxicity.score_documents(docs.limit(0), lex).count() == 0


def brute_language(train, text):
    """The language, its score and all bits' outputs by plain sums over trigrams of bytes."""
    import math
    from collections import Counter

    def grams(t):
        low = b" " + t.lower().encode() + b" "
        low = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in low)
        return [((low[i] << 16 | low[i + 1] << 8 | low[i + 2]) * 2654435761 % (1 << 32)) >> 16 for i in range(len(low) - 2) if low[i + 1] != 32]

    share = {}
    for lang, t in train:
        g = grams(t)
        for b, n in Counter(g).items():
            share.setdefault(lang, Counter())[b] += n / len(g)
    langs = sorted(share)
    for c in share.values():
        total = sum(c.values())
        for b in c:
            c[b] /= total
    codes = [[1 if s >> i & 1 else -1 for s in range(1, 1 << (len(langs) - 1))] for i in range(len(langs))]
    g, outputs, trust = grams(text), [], []
    for bit in range(len(codes[0])):
        side = lambda s: [x for x, c in zip(langs, codes) if c[bit] == s]  # noqa: B023, E731
        weight = lambda b: math.log(sum(share[x][b] for x in side(1)) / len(side(1)) + 1e-6) - math.log(sum(share[x][b] for x in side(-1)) / len(side(-1)) + 1e-6)  # noqa: B023, E731
        outputs.append(sum(map(weight, g)) / len(g))
        gaps = [c[bit] * sum(p * weight(b) for b, p in share[x].items()) for x, c in zip(langs, codes)]
        trust.append(max(0.05, math.tanh(min(gaps))))
    losses = [sum(w * math.log1p(math.exp(-8 * f * c)) for f, c, w in zip(outputs, code, trust)) for code in codes]
    least = min(losses)
    return langs[losses.index(least)], 1 / sum(math.exp(least - x) for x in losses)


def test_language_against_plain_sums(spark):
    r = random.Random(9)
    words = {x: ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(40)] for x, letters in (("aa", "abcdeé"), ("bb", "cdefgh"), ("cc", "efghijñ"))}
    say = lambda x, n: " ".join(r.choice(words[x]) for _ in range(n))
    rows = [(i, say(x, r.randint(3, 30)), x) for i in range(120) for x in [r.choice(list(words))]]
    train = [(x, t) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {g.doc_id: (g.lang_pred, g.score) for g in langid.predict(docs, langid.fit(docs)).collect()}
    for i, t, _ in rows[:40]:
        lang, score = brute_language(train, t)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4


def test_many_and_rare_languages_are_learned(spark):
    """250 languages of a row each beside one of 3,000 rows, all without ids, in a sample of few rows."""
    r = random.Random(10)
    name = lambda: "".join(chr(r.randrange(97, 123)) for _ in range(12))
    rows = [(None, f"{name()} {name()} {name()}", f"l{k:03d}") for k in range(250)]
    rows += [(None, " ".join(r.choice(["the", "and", "of", "this"]) for _ in range(12)), "en") for _ in range(3000)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=100)
    assert len(model.langs) == 251
    docs = spark.createDataFrame(rows[:250] + rows[-5:], "doc_id long, text string, lang string")
    out = langid.predict(docs, model, keep=("lang",)).collect()
    assert np.mean([x.lang == x.lang_pred for x in out]) > 0.9


def test_lexicon_against_plain_counts(spark):
    """Entries, weights, curve and scores of a small table, counted word by word."""
    import math
    import re

    r = random.Random(11)
    plain = ["word", "stone", "river", "cloud", "green", "walk", "table", "seven", "paper", "quiet"]
    foul = ["grobnak", "grobnix", "zuvlet"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = [r.choice(plain) for _ in range(r.randint(5, 40))] + [r.choice(foul) for _ in range(r.randint(1, 2) if toxic or r.random() < 0.01 else 0)]
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lex = toxicity.fit(docs, marks)
    of = dict(labels)
    train = [(t, of[i]) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    n1, n0 = sum(y for _, y in train), sum(1 - y for _, y in train)
    counts = [{}, {}]
    for t, y in train:
        for e in {e for w in set(re.findall("[a-z]+", t)) for e in [w + "$", *(w[:k] for k in range(2, 9) if len(w) >= k)]}:
            counts[y][e] = counts[y].get(e, 0) + 1
    want = {}
    for e, a in counts[1].items():
        z = counts[0].get(e, 0)
        w = math.log((a + 0.5) / (n1 + 1)) - math.log((z + 0.5) / (n0 + 1))
        if w > 2 and (a - 1.64 * a**0.5) / n1 > 3 * (z + 1) / n0:
            want[e] = w
    assert want and all(abs(want[e] - w) < 1e-12 for e, w in lex.weights.items() if e in want)
    learned = {e for e in lex.weights if e.rstrip("$") not in toxicity.GIVEN}
    assert learned and learned <= want.keys()
    # what is left out is begun by an entry that weighs as much, less 0.7
    assert all(any(e.rstrip("$").startswith(k) and lex.weights[k] >= want[e] - 0.7 for k in learned if not k.endswith("$")) for e in want.keys() - learned)
    # the curve is where the damped likelihood is greatest: its slope is zero
    a, b, c = lex.curve
    slope = [-1e-3 * a, -1e-2 * b, -1e-2 * c]
    for t, y in train:
        total, _ = brute_matched(lex, t)
        x = [1.0, round(math.log1p(total), 2), round(math.log1p(100 * total / (t.count(" ") + 21)), 2)]
        p = 1 / (1 + math.exp(-(a + b * x[1] + c * x[2])))
        slope = [s + (y - p) * v for s, v in zip(slope, x)]
    assert max(map(abs, slope)) < 1e-4
    out = {x.doc_id: (x.score, x.predicted) for x in toxicity.score_documents(docs, lex).collect()}
    for i, t in rows[:100]:
        total, _ = brute_matched(lex, t)
        p = 1 / (1 + math.exp(-(a + b * math.log1p(total) + c * math.log1p(100 * total / (t.count(" ") + 21)))))
        assert abs(out[i][0] - p) < 1e-9 and out[i][1] == int(p >= 0.3)


def test_folding_of_accents_and_spaced_letters():
    for text in ("ïdïot", "ɪdɪot", "𝐢𝐝𝐢𝐨𝐭", "i.d.i.o.t", "ｉ-ｄ-ｉ-ｏ-ｔ", "Ídîöt"):
        assert toxicity.fold(text) == "idiot"
    assert toxicity.fold("e.g. this, a.b") == "e.g. this, a.b"


def test_long_words_are_whole(spark):
    long = "q" * 50
    docs = spark.createDataFrame([(i, f"{long} here" if i % 2 else "plain here") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    lex = toxicity.fit(docs, labels)
    assert lex.matched(long)[1] == 1 and f"{long}$" in toxicity.entries_of(long) and f"{long[:40]}$" not in toxicity.entries_of(long)


def test_rare_words_are_learned(spark):
    """A word in one of 200 toxic rows and in no other, which chance alone does not explain."""
    r = random.Random(12)
    rows, labels = [], []
    for i in range(12_000):
        toxic = i % 3 == 0
        words = [f"w{r.randrange(40)}" for _ in range(6)]
        if toxic:
            words.append("vorglat" if i % 600 == 0 else f"foul{'abcdefghij'[r.randrange(10)]}")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    lex = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert lex.score("w1 w2 vorglat w3") > 0.9 and lex.matched("vorglat")[1] == 1
    assert lex.score("w1 w2 w3") < 0.3


def test_losses_of_thousands_of_languages_take_little_memory():
    import tracemalloc

    r = np.random.default_rng(4)
    codes = np.where(r.integers(0, 2, (5000, 63)) > 0, 1, -1)
    model = langid.Model([str(i) for i in range(5000)], codes, np.zeros((63, 4)), r.uniform(0.05, 1, 63))
    f = r.normal(size=(256, 63))
    tracemalloc.start()
    best, score = model.decode(f)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    for i in range(0, 256, 51):
        loss = (np.logaddexp(0, -langid.STEEPNESS * f[i] * codes) * model.trust).sum(1)
        assert best[i] == loss.argmin() and abs(score[i] - 1 / np.exp(loss.min() - loss).sum()) < 1e-9
