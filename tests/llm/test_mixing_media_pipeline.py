import hashlib
import io
import random
import wave
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F
import pytest

import corpus_pipeline
from marginflow.llm import media, mixing
from marginflow.llm.common import read


def test_one_period_is_pfair():
    """In every prefix each source's blocks differ from its share by less than one, and no deadline is missed."""
    r = random.Random(0)
    for _ in range(40):
        parts = mixing.round_weights({f"s{i}": r.random() ** 3 + 1e-4 for i in range(r.randint(1, 12))}, 200)
        assert sum(parts.values()) == 200 and min(parts.values()) >= 1
        order, seen = mixing.one_period(parts), Counter()
        for slot, s in enumerate(order, 1):
            seen[s] += 1
            assert all(abs(seen[x] - Fraction(slot * p, 200)) < 1 for x, p in parts.items())
        assert seen == Counter(parts)


def brute_schedule(blocks, weights, period):
    """Slot by slot: the earliest deadline among released blocks, anew whenever a source runs out."""
    done, out = dict.fromkeys(blocks, 0), []
    while any(done[s] < blocks[s] for s in blocks):
        left = [s for s in blocks if done[s] < blocks[s]]
        parts = mixing.round_weights({s: weights[s] for s in left}, max(period, len(left)))
        q, k, slot = sum(parts.values()), dict.fromkeys(left, 0), 0
        while all(done[s] < blocks[s] for s in left):
            ready = [(-(-(k[s] + 1) * q // parts[s]), s) for s in left if k[s] * q // parts[s] <= slot]
            s = min(ready)[1]
            out.append((s, done[s]))
            done[s] += 1
            k[s] += 1
            slot += 1
    return out


def test_mix_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None])) for i in range(500)] + [(3, "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "1 AS mix_slot", "'x' AS extra")
    weights = {"a": 1.0, "b": 5.0, "c": 2.0}
    out = mixing.mix(docs, weights, block_rows=4, period=16).collect()
    assert Counter((x.doc_id, x.source) for x in out) == Counter(rows)
    assert sorted(x.mix_position for x in out) == list(range(len(rows)))
    counts = Counter(s or "" for _, s in rows)
    want = brute_schedule({s: -(-n // 4) for s, n in counts.items()}, {**weights, "": 1.0}, 16)
    by_slot = {}
    for x in out:
        by_slot.setdefault(x.mix_slot, []).append(x)
    assert [by_slot[k][0].source or "" for k in range(len(want))] == [s for s, _ in want]
    assert all(len({x.source for x in v}) == 1 for v in by_slot.values())
    assert all(max(p.mix_position for p in by_slot[k]) < min(p.mix_position for p in by_slot[k + 1]) for k in range(len(want) - 1))


def ideal(blocks, weights, slots):
    """Blocks of each source that the ideal schedule has served after so many slots, in fractions."""
    done, left = dict.fromkeys(blocks, Fraction(0)), Fraction(slots)
    while left:
        lasting = [s for s in blocks if done[s] < blocks[s]]
        total = sum(Fraction(weights[s]) for s in lasting)
        step = min(left, *((blocks[s] - done[s]) * total / Fraction(weights[s]) for s in lasting))
        for s in lasting:
            done[s] += step * Fraction(weights[s]) / total
        left -= step
    return done


def held(rows, weights, step=1):
    """That every step-th prefix holds each source's exact share to within one block, and all blocks come once."""
    blocks, seen, at = {s: -(-n // 8) for s, n in rows.items()}, Counter(), 0
    for s, k, phase, slot, start in mixing.streamed(rows, weights):
        assert (k, slot, start) == (seen[s], sum(seen.values()) if step == 1 else slot, at)
        assert step > 1 or phase == sum(seen[x] == blocks[x] for x in blocks)
        seen[s] += 1
        at += min(8, rows[s] - 8 * k)
        if (slot + 1) % step == 0:
            want = ideal(blocks, weights, slot + 1)
            assert all(abs(seen[x] - want[x]) <= 1 for x in blocks)
    assert seen == Counter(blocks) and at == sum(rows.values())


def test_streamed_shares_are_exact():
    r = random.Random(2)
    for _ in range(15):
        rows = {f"s{i}": r.randint(1, r.choice([20, 400])) for i in range(r.randint(1, 9))}
        held(rows, {s: r.choice([n**0.5, r.random() + 1e-3, 1.0]) for s, n in rows.items()})
    # 37,500 slots: weights rounded to 1 / 1000 would be off by many blocks
    held({"a": 200_000, "b": 100_000}, {"a": 2**0.5, "b": 1.0}, 997)
    # a large source among many small ones keeps its own share
    rows = {"hot": 100_000} | {f"s{i}": 10 for i in range(800)}
    held(rows, {s: n**0.5 for s, n in rows.items()}, 1499)


def test_many_sources_are_mixed(spark):
    """600 small sources and a large one: no number of sources turns weights off."""
    docs = spark.range(6000 + 4800).selectExpr("id AS doc_id", "IF(id < 6000, 'hot', concat('s', id % 600)) AS source")
    out = sorted(mixing.mix(docs).collect(), key=lambda x: x.mix_position)
    assert [x.mix_position for x in out] == list(range(10800)) and {x.doc_id for x in out} == set(range(10800))
    rows = Counter(x.source for x in out)
    blocks = {s: -(-n // 8) for s, n in rows.items()}
    want = ideal(blocks, {s: n**0.5 for s, n in rows.items()}, 500)
    seen = Counter(x.source for x in out if x.mix_slot < 500)
    assert all(abs(seen[s] / 8 - want[s]) <= 1 for s in rows) and len({x.mix_slot for x in out if x.source == "hot"}) == blocks["hot"]
    with pytest.raises(ValueError):
        mixing.mix(docs, {"hot": 0.0})


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, source string")
    assert [x.mix_position for x in mixing.mix(docs).collect()] == [0]
    assert mixing.mix(docs.limit(0)).count() == 0
    many = spark.range(1200).selectExpr("id AS doc_id", "concat('s', id % 600) AS source")
    assert sorted(x.mix_position for x in mixing.mix(many).collect()) == list(range(1200))


def test_stored_in_order(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source")
    stored = mixing.stored_in_order(mixing.mix(docs), rows_per_file=300)
    parts = stored.selectExpr("spark_partition_id() AS p", "mix_position").collect()
    assert [x.mix_position for x in sorted(parts, key=lambda x: x.p)] == list(range(1000))
    assert stored.rdd.getNumPartitions() == 4


# media


def test_media(spark):
    rows = [(1, "hello world " * 300), (2, None), (3, ""), (4, "é" * 288), (4, "é" * 288), (5, "hello world " * 300), (None, "x" * 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS extra")
    out = media.media_columns(docs).collect()
    assert len(out) == len(rows)
    for r, (i, text) in zip(sorted(out, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0]))):
        data = (text or "").encode()
        payload = data + b"\xff" * (576 if not data else -len(data) % 576)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes == len(r.wav) and r.media_sha256 == hashlib.sha256(r.wav).hexdigest()
        with wave.open(io.BytesIO(bytes(r.wav))) as w:
            assert w.readframes(w.getnframes()) == payload
        assert len(r.frames) == len(r.hashes) == r.n_landmarks and r.frames == sorted(r.frames)
    same = [tuple(r)[1:] for r in out if r.doc_id in (1, 5)]
    assert same[0] == same[1]
    with pytest.raises(ValueError):
        media.media_columns(docs.withColumnRenamed("extra", "feature"), keep=("feature",))
    assert media.media_columns(docs.limit(0)).count() == 0


def test_peaks_of_tones():
    """Two tones give their bins in every frame that they fill, and pairs of them."""
    t = np.arange(media.WINDOW * 20)
    x = 128 + 60 * np.sin(2 * np.pi * 20 * t / media.WINDOW) + 30 * np.sin(2 * np.pi * 70 * t / media.WINDOW)
    bins, found = media.peaks(np.rint(x).astype(np.uint8).tobytes())
    full = slice(1, (len(t) + media.EDGE - media.WINDOW) // media.HOP + 1)
    assert found[full].all() and set(map(tuple, bins[full].tolist())) == {(20, 70)}
    frames, hashes = media.landmarks(np.rint(x).astype(np.uint8).tobytes())
    inside = (frames > 0) & (frames + media.AHEAD < full.stop)
    assert set(hashes[inside].tolist()) == {b << 16 | 20 << 4 | g for b in (20, 70) for g in (1, 2, 3)}
    assert Counter(frames.tolist())[1] == media.AHEAD * media.PEAKS


def test_a_last_byte_alone_changes_the_spectrum(monkeypatch):
    seen = []
    fft = np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda part, axis: seen.append(part.copy()) or fft(part, axis=axis))
    for last in (0, 255):
        media.peaks(bytes([7] * (media.UNIT - 1) + [last]))
    assert (seen[0][-1] != seen[1][-1]).any()


def test_blocks_of_frames_do_not_matter(monkeypatch):
    x = np.random.default_rng(0).integers(0, 256, 576 * 40, dtype=np.uint8).tobytes()
    whole = media.landmarks(x)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, media.landmarks(x)))


# pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against what its operator decides on the stage's own input."""
    folder = "/root/testdata/sf0.001"
    docs = read(spark, folder, "documents")
    junk = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "12 %", "en", "src0", 4)], docs.schema)
    docs = docs.unionByName(junk)
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id for r in docs.collect()})
    first, lines, near, mixed, coded = kept
    assert 10**6 not in first and 10**6 + 1 not in first and len(first) >= 198
    assert lines == first and near < lines and mixed == near and coded == near
    # five-word shingles: no two texts of 0.85 or more stay, and what goes has one like it
    texts = {r.doc_id: (r.text or "").lower().split() for r in spark.read.parquet(str(tmp_path / "1")).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items() if len(w) > 4}
    like = {i: {} for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(common := sets[i] & sets[j]) * 4 > max(len(sets[i]), len(sets[j])):
                like[i][j] = like[j][i] = len(common) / len(sets[i] | sets[j])
    assert all(x < 0.85 for i in near & sets.keys() for j, x in like[i].items() if j in near)
    assert all(max(like[i].values(), default=0) >= 0.55 for i in sets.keys() - near)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows) and all(r.n_tokens >= 0 for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "bpe_encoding"]


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids, repeated rows, columns named like results, and a table without rows pass all stages."""
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    names = ["score", "lang_pred", "ambiguous", "n_deleted", "mix_slot", "text_clean", "sig", "component_id"]
    odd = docs.selectExpr("*", *[f"doc_id AS {n}" for n in names])
    some = odd.where("doc_id < 40")
    odd = odd.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("long")))
    out, sizes = odd, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = out
        out = stage(spark, out, "")
        if k < 4:
            assert out.columns == odd.columns and out.dtypes == odd.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows = out.collect()
        sizes.append(len(rows))
        assert k == 4 or all(r[n] == r.mix_slot for r in rows for n in names), name
        assert name != "mixing" or Counter(rows) == Counter(before.collect())
    assert sizes[0] == sizes[1] > sizes[2] == sizes[3] == sizes[4]
    nulls = spark.read.parquet(str(tmp_path / "2")).where("doc_id IS NULL").count()
    assert nulls == spark.read.parquet(str(tmp_path / "0")).where("doc_id IS NULL").count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_ties_are_broken_by_the_row(spark):
    """Rows without an id get the same positions however they are dealt."""
    docs = spark.range(3000).selectExpr("IF(id % 3 = 0, null, id) AS doc_id", "concat('s', id % 4) AS source", "concat('text ', id) AS text")
    a, b = ({(r.doc_id, r.text): r.mix_position for r in mixing.mix(docs.repartition(n, "text")).collect()} for n in (3, 7))
    assert a == b and sorted(a.values()) == list(range(3000))


def test_feature_against_a_plain_transform():
    """Frames, spectra by the definition, peaks and pairs, one by one."""
    r = random.Random(3)
    for n in (1, 3):
        x = bytes(r.choice(b"abc defg, hij\xff") for _ in range(media.UNIT * n))
        count = 1 + -(-(len(x) + 128 - 256) // 192)
        k = np.arange(256)
        turn = np.exp(-2j * np.pi * np.outer(np.arange(129), k) / 256)
        tops = []
        for f in range(count):
            part = [x[j] - 128 if 0 <= (j := f * 192 + i - 64) < len(x) else 0 for i in range(256)]
            level = np.rint(np.log2(np.abs(turn @ (np.array(part) * (0.5 - 0.5 * np.cos(2 * np.pi * k / 256)))) ** 2 + 1) * 8)
            local = [b for b in range(1, 128) if level[b] > level[b - 1] and level[b] >= level[b + 1]]
            tops.append(sorted(local, key=lambda b: (-level[b], b))[:2])
        want = [(f, tops[f][p] << 16 | tops[f + g][0] << 4 | g) for f in range(count) for g in (1, 2, 3) if f + g < count for p in range(len(tops[f])) if tops[f + g]]
        frames, hashes = media.landmarks(x)
        assert list(zip(frames.tolist(), hashes.tolist())) == want


def test_every_byte_can_reach_the_feature():
    """A change of any one byte can move a peak."""
    r = np.random.default_rng(5)
    x = r.integers(122, 134, media.UNIT, dtype=np.uint8)
    base = [a.tolist() for a in media.peaks(x.tobytes())]
    for at in range(media.UNIT):
        tried = []
        for level in (0, 255, 64, 192):
            loud = x.copy()
            loud[at] = level
            tried.append([a.tolist() for a in media.peaks(loud.tobytes())] != base)
        assert any(tried), at


def test_copies_lose_their_text_and_then_go(spark, tmp_path):
    """A document that is quoted for the most part loses the quotation, whatever its share; near copies, of which line
    dedup leaves little, are known by the texts that they came with."""
    r = random.Random(21)
    say = lambda n: " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 8))) for _ in range(n)) + ".\n"
    passage = "".join(say(12) for _ in range(10))
    first, quoting = passage + "".join(say(12) for _ in range(12)), "".join(say(11) for _ in range(4)) + passage
    # every fifth line of the copy differs in a word
    near = "".join(line if k % 5 else line.replace(line.split()[3], "altered", 1) for k, line in enumerate(first.splitlines(True)))
    rows = [(1, first, "en", "s", 0), (2, quoting, "en", "s", 0), (3, near, "en", "s", 0), (4, first, "en", "s", 0), (5, say(40), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    lines = corpus_pipeline.line_stage(spark, docs, str(tmp_path))
    left = {x.doc_id: x.text for x in lines.collect()}
    assert left[1] == first and left[4] == "" and left[5] == rows[4][1]
    assert not set(passage.splitlines()) & set(left[2].splitlines()) and set(quoting.splitlines()[:4]) <= set(left[2].splitlines())
    assert len(left[3]) < len(near) / 2
    kept = {x.doc_id for x in corpus_pipeline.near_stage(spark, lines, str(tmp_path)).collect()}
    assert kept == {1, 2, 5}
    # without the table, by what is left of them
    assert {1, 2, 5} <= {x.doc_id for x in corpus_pipeline.near_stage(spark, lines, "").collect()}


def test_near_dedup_without_the_given_table(spark, tmp_path):
    """A stage's documents need not be those of a table in its folder, nor have ids of that table's type."""
    r = random.Random(22)
    say = lambda n: " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 8))) for _ in range(n))
    first = say(200)
    rows = [(1, first, "en", "s", 0), (2, first.replace(first.split()[50], "altered", 1), "en", "s", 0), (3, say(200), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (tmp_path / "empty" / "documents.parquet").mkdir(parents=True)
    for folder in (tmp_path / "absent", tmp_path / "empty"):
        with pytest.warns(UserWarning, match="has no documents"):
            near = corpus_pipeline.near_stage(spark, docs, str(folder))
        assert {x.doc_id for x in near.collect()} == {1, 3}
    # by the table's texts 1 and 3 are copies; ids of letters there are no document's here
    docs.withColumns({"doc_id": F.expr("IF(doc_id = 2, 'b', string(doc_id))"), "text": F.lit(first)}).write.parquet(str(tmp_path / "documents.parquet"))
    assert {x.doc_id for x in corpus_pipeline.near_stage(spark, docs, str(tmp_path)).collect()} == {1}
