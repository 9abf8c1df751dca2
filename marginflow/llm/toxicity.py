"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones and digits or signs inside words to the
letters they stand for. The lexicon holds beginnings of words and whole words with weights; it is learned from
labelled rows on top of a short list given. Matches inside exception phrases don't count. The weight matched, by
itself and by length, goes through a logistic curve fitted to the labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import with_code
from .common import checkpointed, train_split

#: Labelled rows in the training sample, as expected number: rows are taken by hash of their id.
SAMPLE_ROWS = 16_384
#: Sampled ids up to which they are broadcast; beyond, the texts are joined by id.
BROADCAST_IDS = 1_000_000
#: Decimals of the features that the curve is fitted to.
GRID = 2
#: Lengths of the beginnings of words that are tried.
PREFIXES = range(2, 9)
#: The test of an entry: see ``chosen``.
LEAST_WEIGHT, CHANCE, TIMES = 2.0, 1.64, 3
#: Words known beforehand, with the weight they have where no label tells otherwise.
GIVEN = ("idiot", "moron", "scum", "stupid", "trash", "loser", "worthless", "pathetic", "disgusting", "clown")
#: Phrases in which a match is meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "not stupid", "no idiot", "loser bracket")

#: Letters that look like Latin ones, in the order of those they stand for.
_CYRILLIC, _CYRILLIC_AS = "аеорсухіјѕԁһԛԝкмтвнгзбчѵүёїӏ", "aeopcyxijsdhqwkmtbhr3b4vyeil"
_GREEK, _GREEK_AS = "αβεγηικνορτυχωζμ", "abeynikvoptuxwzu"
_ARMENIAN, _ARMENIAN_AS = "աոսցօհյքզ", "anugohjqq"
_SMALL_CAPS, _SMALL_CAPS_AS = "ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢıɑɡɩʋøđħłŧæœß", "abcdefghijklmnoprstuvwyziagivodhltaob"
_HOMOGLYPHS = str.maketrans(_CYRILLIC + _GREEK + _ARMENIAN + _SMALL_CAPS, _CYRILLIC_AS + _GREEK_AS + _ARMENIAN_AS + _SMALL_CAPS_AS)
#: Marks that decomposed letters carry, and signs that are not seen.
_UNSEEN = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]")
#: Letters one by one with a sign between them.
_APART = re.compile(r"(?<![^\W_])(?:[a-z][.\-_*·]){2,}[a-z](?![^\W_])")
_HAS_APART = re.compile(r"[a-z][.\-_*·][a-z][.\-_*·][a-z]")
_SIGNS = str.maketrans("013457@$", "oieastas")
_MIXED = re.compile(r"(?<=[a-z])[013457@$]+(?=[a-z])|(?<![^\W_])[013457@$]+(?=[a-z]{2})|(?<=[a-z][a-z])[013457](?![^\W_])")
_HAS_SIGN = re.compile(r"[a-z][013457@$]|[013457@$][a-z]")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case; compatibility forms, accents and look-alikes to plain letters; digits and signs inside words to
    the letters they stand for; letters set apart by signs together. Other letters, spacing and signs stay."""
    text = text.lower()
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text)).lower().translate(_HOMOGLYPHS)
    if _HAS_SIGN.search(text):
        for _ in range(2):  # signs next to signs
            text = _MIXED.sub(lambda m: m[0].translate(_SIGNS), text)
    if _HAS_APART.search(text):
        text = _APART.sub(lambda m: re.sub(r"[^a-z]", "", m[0]), text)
    return text


@dataclass
class Lexicon:
    """weights: by entry, ``abc`` for words that begin so and ``abc$`` for the whole word. curve: the logistic
    curve's constant and its factors for the weight matched and the weight by length."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-2.0, 1.5, 0.0)
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            entries: dict[str, list[float]] = {}
            for e, w in self.weights.items():
                entries.setdefault(e.rstrip("$"), [0.0, 0.0])[e.endswith("$")] = w
            for e, (begin, whole) in entries.items():
                a.add_word(e, (len(e), begin, whole, False))
            for e in map(fold, self.exceptions):
                old = entries.get(e, (0.0, 0.0))
                a.add_word(e, (len(e), *old, True))
            if len(a):
                a.make_automaton()
            self._machine = a
        return self._machine

    def matched(self, text: str) -> tuple[float, int, int]:
        """Weight matched, number of words matched and number of words of the folded text.

        In a word the heaviest entry counts. A word whose start lies in an exception phrase doesn't.
        """
        folded = fold(text)
        words = folded.count(" ") + folded.count("\n") + 1
        machine = self.machine()
        if not len(machine):
            return 0.0, 0, words
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, begin, whole, exception) in machine.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalpha():
                continue
            if exception and (end + 1 == len(folded) or not folded[end + 1].isalpha()):
                spared.append((start, end))
            w = begin
            if whole > begin and (end + 1 == len(folded) or not folded[end + 1].isalpha()):
                w = whole
            if w > best.get(start, 0.0):
                best[start] = w
        for lo, hi in spared:
            for s in [s for s in best if lo <= s <= hi]:
                del best[s]
        return sum(best.values()), len(best), words

    def features(self, text: str | None) -> tuple[float, float]:
        weight, _, words = self.matched(text) if text else (0.0, 0, 1)
        return math.log1p(weight), math.log1p(100 * weight / (words + 20))

    def score(self, text: str | None) -> float:
        x, y = self.features(text)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x + c * y))))


def entries_of(text: str) -> set[str]:
    """The beginnings and wholes of a folded text's words."""
    out = set()
    for w in set(_WORD.findall(fold(text))):
        if len(w) > 1:
            out.add(w + "$")
            out.update(w[:k] for k in PREFIXES if len(w) >= k)
    return out


def _tally(rows: DataFrame) -> DataFrame:
    """(entry, a, z): toxic and other rows of (toxic, text) that have each entry, counted within a partition first."""

    def run(batches):
        import pyarrow as pa

        counts: tuple[Counter[str], Counter[str]] = Counter(), Counter()
        read = 0

        def flush():
            for toxic, c in enumerate(counts):
                n, none = pa.array(list(c.values()), pa.int64()), pa.array([0] * len(c), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), *((n, none) if toxic else (none, n))], names=["entry", "a", "z"])
                c.clear()

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = entries_of(text.as_py())
                counts[toxic == 1].update(found)
                read += len(found) + sum(map(len, found)) // 16
                if read > 2_000_000:
                    yield from flush()
                    read = 0
        yield from flush()

    found = with_code(rows).select("toxic", "text").mapInArrow(run, "entry string, a long, z long")
    return found.groupBy("entry").agg(F.sum("a").alias("a"), F.sum("z").alias("z"))


def telling(tally: DataFrame, n1: int, n0: int) -> DataFrame:
    """The entries of a tally that tell toxic rows from others, by the test that ``chosen`` states."""
    a, z = F.col("a"), F.col("z")
    heavy = F.log((a + 0.5) / (n1 + 1.0)) - F.log((z + 0.5) / (n0 + 1.0)) > LEAST_WEIGHT
    return tally.where(heavy & ((a - CHANCE * F.sqrt(a)) / float(n1) > TIMES * (z + 1) / float(n0)))


def _curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of rows that occur n times, with a little damping, by Newton's steps."""
    design, b = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    damp = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        h = design.T @ (design * (n * p * (1 - p))[:, None]) + damp
        step = np.linalg.solve(h, design.T @ (n * (y - p)) - damp @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def chosen(ones: dict[str, int], zeros: dict[str, int], n1: int, n0: int) -> dict[str, float]:
    """Weights of the entries kept, from their counts in n1 toxic and n0 other rows.

    The weight is the log ratio of both rates. It lies above LEAST_WEIGHT, and the toxic rate, less CHANCE standard
    deviations, above TIMES the other. An entry that a kept shorter one begins goes, unless it weighs 0.7 more.
    """
    weight = {}
    for e, a in ones.items():
        w = math.log((a + 0.5) / (n1 + 1)) - math.log((zeros.get(e, 0) + 0.5) / (n0 + 1))
        if w > LEAST_WEIGHT and (a - CHANCE * math.sqrt(a)) / n1 > TIMES * (zeros.get(e, 0) + 1) / n0:
            weight[e] = w
    kept: dict[str, float] = {}
    for e in sorted(weight, key=lambda e: (len(e.rstrip("$")), e)):
        stem = e.rstrip("$")
        if not any(kept.get(stem[:k], 0) >= weight[e] - 0.7 for k in range(1, min(len(stem), PREFIXES[-1]) + 1)):
            kept[e] = weight[e]
    return kept


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """A lexicon and curve from labelled rows that are not held out.

    About ``sample_rows`` ids are used, by their hash; an id with several labels is toxic if one of them says so, and
    each of its documents counts. Entries much likelier in toxic rows are kept, the shortest of those that say the
    same; no number of entries and of rows is set, but those that chance may have put in toxic rows are not kept. The
    driver gets the entries that pass that test, and the rows' features on a grid. Without
    labels of both kinds the given words and a fixed curve are used.
    """
    usable = F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~train_split(F.col("doc_id"))
    marked = labels.where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    share = min(1.0, sample_rows / max(1, n))
    marked = checkpointed(marked.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
    given = {f"{w}$": 3.0 for w in GIVEN}
    small = F.broadcast(marked) if marked.count() <= BROADCAST_IDS else marked
    rows = docs.select("doc_id", "text").join(small, "doc_id").where("text IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sum(sizes.values()) - sizes.get(1, 0)
    if not n1 or not n0:
        return Lexicon(given)
    told = telling(_tally(rows), n1, n0).collect()
    top = chosen({r.entry: r.a for r in told}, {r.entry: r.z for r in told}, n1, n0)
    lexicon = Lexicon({**{e: w for e, w in given.items() if e.rstrip("$") not in top}, **top})

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            # on a grid, so that the driver's share is bounded however often an id's documents repeat
            got = [[round(v, GRID) for v in lexicon.features(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), *(pa.array([g[i] for g in got], pa.float64()) for i in (0, 1))], names=["toxic", "x", "y"])

    found = with_code(rows).select("toxic", "text").mapInArrow(features, "toxic int, x double, y double")
    # equal rows are counted first; the driver puts the rest in order, so that sums don't depend on it
    got = sorted(tuple(r) for r in found.groupBy("toxic", "x", "y").count().collect())
    y, n = np.array([float(g[0] == 1) for g in got]), np.array([float(g[3]) for g in got])
    lexicon.curve = _curve(np.array([g[1:3] for g in got]), y, n)
    return lexicon


def score_documents(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The ``keep`` columns with score (0 to 1), predicted (1 from ``threshold`` on) and n_matched, for every row.

    Whole texts, one pass, no shuffle. A null or empty text has the curve's score for no match; repeated rows give
    repeated rows.
    """
    names = ["score", "predicted", "n_matched"]
    if clash := {*names} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} clash with the result's")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores, hits = [], []
            a, b, c = lexicon.curve
            for t in batch.column(len(keep)):
                value = t.as_py()
                weight, n, words = lexicon.matched(value) if value else (0.0, 0, 1)
                z = a + b * math.log1p(weight) + c * math.log1p(100 * weight / (words + 20))
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
                hits.append(n)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(hits, pa.int64())], names=[*keep, *names])

    kinds = ", ".join([*(f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double, predicted int, n_matched long"])
    return with_code(docs).select(*keep, text).mapInArrow(run, kinds)
