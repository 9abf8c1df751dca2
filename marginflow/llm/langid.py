"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a binary naive-Bayes classifier over hashed byte trigrams tells the
languages whose bit is 1 from the rest; its output is the mean log-odds of the text's trigrams. The codeword with
the least weighted logistic loss wins, each bit weighted by how well it did on the training sample.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import with_code
from .common import checkpointed, slices, train_split

BUCKETS = 1 << 16
#: Labelled rows in the training sample, as expected number: rows are taken by hash of their id and text.
SAMPLE_ROWS = 8192
#: Rows of each language that come into the sample besides, as expected number, however rare the language is.
RARE_ROWS = 64
#: Languages up to which their sizes are broadcast; beyond, texts are joined by language.
BROADCAST_LANGS = 100_000
#: Below this score, with no language as likely as the rest together, the nearest codeword is called ambiguous.
CLEAR = 0.5
#: Mean log-odds are multiplied by this before the logistic loss.
STEEPNESS = 8.0
#: Bytes scored at a time.
BLOCK = 1 << 20
UNIT = 1 << 30

_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ASCII_LETTER = re.compile(rb"[a-z]")


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: every split of the languages for up to six, else hashed bits, 10 for each doubling."""
    if n <= 6:
        return np.array([[1 if (s >> i) & 1 else -1 for s in range(1, 1 << max(0, n - 1))] for i in range(n)], np.int8).reshape(n, (1 << max(0, n - 1)) - 1)
    bits, out = 10 * (n - 1).bit_length(), []
    for b in range(4 * bits):
        column = [1 if hashlib.sha256(f"{b}:{i}".encode()).digest()[0] & 1 else -1 for i in range(n)]
        if abs(sum(column)) < n and len(out) < bits:
            out.append(column)
    return np.array(out, np.int8).T


def cleaned(text: str) -> bytes:
    """Lower case, everything in ASCII but letters blanked, a blank at either end."""
    return b" " + text.lower().encode("utf-8", "replace").translate(_KEEP) + b" "


def has_letter(text: str, clean: bytes) -> bool:
    return bool(_ASCII_LETTER.search(clean)) or (not text.isascii() and any(map(str.isalpha, text)))


def trigrams(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each place, and whether it counts (its middle is no blank)."""
    a = np.frombuffer(block, np.uint8)
    x = (a[:-2].astype(np.uint32) << 16) | (a[1:-1].astype(np.uint32) << 8) | a[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32), a[1:-1] != 32


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (bits, BUCKETS)
    trust: np.ndarray  # (bits,)

    def outputs(self, texts: list[bytes]) -> np.ndarray:
        """(texts, bits): mean log-odds of each cleaned text's trigrams; 0 where there is none."""
        out, at = np.zeros((len(texts), self.weights.shape[0])), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
                size += len(texts[end])
                end += 1
            sums, counts = np.zeros((end - at, out.shape[1])), np.zeros(end - at)
            if end - at == 1:  # one text may be longer than a block
                t = texts[at]
                for k in range(0, len(t) - 2, BLOCK):
                    idx, ok = trigrams(t[k : k + BLOCK + 2])
                    idx = idx[ok]
                    counts[0] += len(idx)
                    sums[0] += [w[idx].sum(dtype=np.float64) for w in self.weights]
            else:
                idx, ok = trigrams(b"".join(texts[at:end]) + b"  ")
                starts = np.cumsum([0, *map(len, texts[at : end - 1])])
                counts += np.add.reduceat(ok, starts, dtype=np.int64)
                for b, w in enumerate(self.weights):
                    g = w[idx]
                    g[~ok] = 0
                    sums[:, b] = np.add.reduceat(g, starts, dtype=np.float64)
            out[at:end] = sums / np.maximum(counts, 1)[:, None]
            at = end
        return out

    def decode(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and its score, the softmax of minus the losses."""
        # a bit's loss is one of two numbers, so losses of all languages are two products
        right, wrong = (np.logaddexp(0, sign * STEEPNESS * f) * self.trust for sign in (-1, 1))
        ones = (self.codes > 0).astype(float)
        loss = right @ ones.T + wrong @ (1 - ones).T
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return loss.argmin(1), 1 / p.sum(1)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, rare_rows: int = RARE_ROWS) -> Model:
    """A model from ``text`` and non-null ``lang`` of rows that are not held out, for all languages among them.

    About ``sample_rows`` rows are used, picked by hash of id and text, and at least about ``rare_rows`` of each
    language. Executors sum each text's trigram shares as integers, so sums don't depend on order; the driver gets
    a number for each language and bucket seen in the sample. Without labelled rows the model has no language and
    predicts ``und``.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~train_split(F.col("doc_id")))
    sizes = checkpointed(rows.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("__n")))
    n = sizes.agg(F.sum("__n")).first()[0] or 0
    share = F.greatest(F.lit(sample_rows / max(1, n)), F.lit(float(rare_rows)) / F.col("__n"))
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    small = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGS else sizes
    picked = rows.select(F.col("lang").cast("string").alias("lang"), "text", u.alias("__u")).join(small, "lang").where(F.col("__u") < share).select("lang", "text")

    def count(batches):
        for batch in slices(batches):
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                idx, ok = trigrams(cleaned(text) + b"  ")
                idx = idx[ok]
                if len(idx):
                    at, times = np.unique(idx, return_counts=True)
                    got = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    got[at] += times * UNIT // len(idx)
                if len(sums) > 32:
                    yield from flush(sums)
                    sums = {}
            yield from flush(sums)

    def flush(sums):
        import pyarrow as pa

        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = with_code(picked).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = counts.column("lang").to_pylist()
    langs = sorted(set(names))
    where = {x: i for i, x in enumerate(langs)}
    of = np.array([where[x] for x in names], np.int64)
    bucket, share_of = counts.column("bucket").to_numpy(), counts.column("n").to_numpy().astype(float)
    if langs:  # a language's shares add up to 1
        order = np.lexsort((bucket, of))  # sums in one order, whatever comes first
        of, bucket, share_of = of[order], bucket[order], share_of[order]
        share_of /= np.bincount(of, share_of, len(langs))[of]
    codes = codewords(len(langs))
    smooth = 1e-6
    weights = np.zeros((codes.shape[1], BUCKETS), np.float32)
    trust = np.ones(codes.shape[1])
    for b in range(codes.shape[1]):
        mean = lambda side: np.bincount(bucket, share_of * (codes[of, b] == side), BUCKETS) / (codes[:, b] == side).sum()  # noqa: B023, E731
        weights[b] = np.log(mean(1) + smooth) - np.log(mean(-1) + smooth)
        gap = np.bincount(of, share_of * weights[b].astype(np.float64)[bucket], len(langs)) * codes[:, b]
        trust[b] = max(0.05, np.tanh(gap.min()))  # how far the worst language lies on its side
    return Model(langs, codes, weights, trust)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with lang_pred, score (0 to 1) and ambiguous, for every row and over whole texts.

    ``und`` with score 0 for a text that is null or has no letter. One pass, no shuffle; repeated rows give
    repeated rows; ties go to the language first in order.
    """
    names = ["lang_pred", "score", "ambiguous"]
    if clash := {*names} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} clash with the result's")

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            n = batch.num_rows
            langs, scores = ["und"] * n, np.zeros(n)
            texts = batch.column(batch.num_columns - 1).to_pylist()
            clean = [cleaned(t) if t else b"" for t in texts]
            rows = [i for i in range(n) if clean[i] and model.langs and has_letter(texts[i], clean[i])]
            if rows:
                best, score = model.decode(model.outputs([clean[i] for i in rows]))
                for i, k, s in zip(rows, best, score, strict=True):
                    langs[i], scores[i] = model.langs[k], s
            arrays = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(scores < CLEAR, pa.bool_())], names=[*keep, *names])

    kinds = ", ".join([*(f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double, ambiguous boolean"])
    return with_code(docs).select(*keep, F.col("text").alias("__text")).mapInArrow(run, kinds)
