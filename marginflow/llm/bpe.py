"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

The merge list fixes how far to the right of a boundary text can matter: ``MergeTable.far`` for the token before the
boundary, ``MergeTable.lookahead`` for any. Each word runs through the transducer (``MergeTable.stream``): every
``STEP`` symbols, the tokens up to the last boundary with enough symbols behind it can no longer change, so they are
emitted and forgotten; the state is the unread tail. The tokens between two boundaries of a tokenisation are the
tokenisation of the text between them, so the transducer may restart at each boundary that it emits. What it made of
a word is remembered in a table of bounded bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import with_code
from .common import slices

#: Symbols read between two looks at which tokens are stable.
STEP = 16
#: Bytes of remembered words in a worker, in two generations; the older one goes when the younger one is full.
MEMO_BYTES = 96 << 20
#: Longest chunk, in characters, that is remembered.
MEMO_CHARS = 256
#: Characters read at a time; a piece ends before white space.
PIECE_CHARS = 1 << 16

#: The pattern by which byte-level tokenizers cut text where their file gives none.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

_SEPARATORS = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")
_NEXT_SPACE = regex.compile(r"(?<!\p{White_Space})\p{White_Space}")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class MergeTable:
    """Vocabulary and merge ranks of a tokenizer file, with the merge list's sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("expected a plain BPE model")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.decoder = (spec.get("decoder") or {}).get("type")
        steps = spec.get("normalizer") or {}
        self.normal = [s["type"] for s in steps.get("normalizers", [steps] if steps else [])]
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [pre])
        split = next((p for p in parts if p.get("type") == "Split"), None)
        own = any(p.get("type") == "ByteLevel" and p.get("use_regex") and not p.get("add_prefix_space") for p in parts)
        if split is None and not own:
            raise ValueError("expected a pre-tokenizer that splits by a pattern")
        self.pattern = regex.compile(split["pattern"]["Regex"] if split else BYTE_LEVEL)
        #: Whether white space only separates words; else it is part of them.
        #: The shortcuts for plain words take it that words are runs of letters.
        self.drops_space = "[\\p{L}]+" in self.pattern.pattern and bool(split and split.get("behavior") == "Removed" and split.get("invert"))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks: dict[tuple[int, int], int] = {}
        #: The token that each merge makes.
        self.made = [self.vocab[x + y] for x, y in merges]
        for rank, (x, y) in enumerate(merges):
            self.ranks[self.vocab[x], self.vocab[y]] = rank
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s) for s in symbols]
        self.final = [self.vocab.get(s + self.suffix) for s in symbols]
        far = self._lookahead(merges)
        #: By token: symbols right of it that can decide whether it stands.
        self.far = [far.get(self.tokens.get(i), 0) for i in range(max(self.tokens, default=-1) + 1)]
        self.width = [self._size(self.tokens.get(i, "")) for i in range(len(self.far))]
        self.lookahead = max(self.far, default=0)

    def _size(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def _lookahead(self, merges: list[tuple[str, str]]) -> dict[str, int]:
        """By token, the most symbols right of it that can decide whether a merge takes it away.

        Whether token y stands when rule r is tried depends on text right of y only through earlier rules that
        take y as their left part, and through the rule that made y, whose right part is subject to the same.
        ``far[y]`` is that distance over the rules seen so far; rules are seen in order of rank. What lies left of a
        boundary that stands is merged the same whatever lies right of it, so the last token alone decides.
        """
        far: dict[str, int] = {}
        for x, y in merges:
            beyond = far.get(y, 0)
            far[x] = max(far.get(x, 0), self._size(y) + beyond)
            far[x + y] = max(far.get(x + y, 0), beyond)
        return far

    def merge(self, ids: list[int]) -> list[int]:
        """The merges in order of rank, leftmost first, over one whole piece of a word."""
        ranks, made, n = self.ranks, self.made, len(ids)
        if n < 2:
            return ids
        if n <= 32:
            return self._merge_short(ids)
        ids, left, right = list(ids), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = right[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j], right[i] = made[r], -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k, m in ((left[i], i), (i, right[i])):
                if k >= 0 and m >= 0 and (r := ranks.get((ids[k], ids[m]))) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[m]))
        return [x for x in ids if x >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same for a short piece: ranks of neighbours in a list, its least taken until none is left."""
        get, made, none = self.ranks.get, self.made, len(self.made)
        ids = list(ids)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i : i + 2] = (made[best],)
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def stream(self, symbols: Iterable[int], step: int = STEP) -> Iterator[int]:
        """Tokens of one word given as a stream of symbols, each emitted once it is stable. No more than about
        ``lookahead``, a token and ``step`` symbols are held."""
        tail: list[int] = []
        seen, far, width = 0, self.far, self.width
        for s in symbols:
            tail.append(s)
            seen += 1
            if seen % step:
                continue
            ids, behind = self.merge(tail), 0
            for k in range(len(ids) - 1, -1, -1):
                if behind >= far[ids[k]]:
                    yield from ids[: k + 1]
                    tail = tail[len(tail) - behind :]
                    break
                behind += width[ids[k]]
        yield from self.merge(tail)

    def symbols(self, word: str) -> Iterator[int]:
        """The symbols of a word (a piece that the pre-tokenizer cuts out), without those that the vocabulary lacks."""
        for at in range(0, len(word), PIECE_CHARS):
            data = word[at : at + PIECE_CHARS].encode()
            last = at + PIECE_CHARS >= len(word)
            for s in map(self.inner.__getitem__, data[:-1] if last else data):
                if s is not None:
                    yield s
            if last and (s := self.final[data[-1]]) is not None:
                yield s


class Encoder:
    """Text to token ids, in pieces; remembers the ids of chunks between white space."""

    def __init__(self, table: MergeTable):
        self.table, self.memo, self.old, self.held = table, {}, {}, 0
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(table.added, key=len, reverse=True))) + ")") if table.added else None

    def _words(self, chunk: str) -> Iterable[str]:
        if chunk.isalpha() or not self.table.drops_space:
            return [chunk]
        if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            return [chunk[:-1], chunk[-1]]  # as the pattern would have it
        return (m[0] for m in self.table.pattern.finditer(chunk))

    def _chunk(self, chunk: str) -> bytes:
        if (out := self.old.get(chunk)) is None:
            words = list(self._words(chunk))
            out = b"".join([self.memo.get(w) or self._word(w) for w in words]) if words != [chunk] else self._word(chunk)
        return self._remember(chunk, out)

    def _word(self, word: str) -> bytes:
        out = self.old.get(word)
        return self._remember(word, array("I", self.table.stream(self.table.symbols(word))).tobytes() if out is None else out)

    def _long(self, chunk: str) -> Iterator[bytes]:
        """The ids of a chunk of any length, in blocks."""
        block = array("I")
        for word in self._words(chunk):
            for token in self.table.stream(self.table.symbols(word)):
                block.append(token)
                if len(block) >= PIECE_CHARS:
                    yield block.tobytes()
                    block = array("I")
        yield block.tobytes()

    def _remember(self, chunk: str, out: bytes) -> bytes:
        if len(chunk) <= MEMO_CHARS and chunk not in self.memo:
            self.held += sys.getsizeof(chunk) + sys.getsizeof(out) + 100  # and the table's own place for it
            self.memo[chunk] = out
            if 2 * self.held > MEMO_BYTES:
                self.old, self.memo, self.held = self.memo, {}, 0
        return out

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE_CHARS:
            cut = _NEXT_SPACE.search(text, at + PIECE_CHARS)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def _normal(self, piece: str) -> list[str]:
        for step in self.table.normal:
            if step == "NFC" and not unicodedata.is_normalized("NFC", piece):
                piece = unicodedata.normalize("NFC", piece)
            elif step == "Lowercase":
                piece = (piece.replace("Σ", "σ") if "Σ" in piece else piece).lower()
        if not self.table.drops_space:
            return self.table.pattern.findall(piece)
        return [x for x in _SPACE.split(piece) if x] if _SEPARATORS.search(piece) else piece.split()

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Blocks of ids as native unsigned 32-bit integers. A null or empty text gives none."""
        if not text:
            return
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield array("I", [self.table.added[part]]).tobytes()
                continue
            for piece in self._pieces(part):
                chunks, get = self._normal(piece), self.memo.get
                if len(piece) <= 2 * PIECE_CHARS:
                    yield b"".join([get(c) or self._chunk(c) for c in chunks])
                else:  # without white space for long
                    for c in chunks:
                        yield from self._long(c)


class Decoder:
    """Token ids to text, in blocks. Without a decoder in the tokenizer's file, token strings joined by blanks;
    with a byte-level one, the bytes run through a UTF-8 state machine that holds an unfinished character."""

    def __init__(self, table: MergeTable):
        self.bytes_mode = table.decoder == "ByteLevel"
        n = max(table.tokens, default=-1) + 1
        back = {s: b for b, s in enumerate(byte_symbols())}
        as_bytes = lambda t: bytes(back[c] for c in t) if self.bytes_mode and all(c in back for c in t) else t.encode()
        self.pieces = [as_bytes(table.tokens.get(i, "")) for i in range(n)]

    def decode(self, blocks: Iterable[bytes]) -> Iterator[bytes]:
        """UTF-8 of the decoded text, in blocks."""
        machine, first, piece = codecs.getincrementaldecoder("utf-8")("replace"), True, self.pieces.__getitem__
        for block in blocks:
            ids = array("I", block)
            if not ids:
                continue
            if self.bytes_mode:
                yield machine.decode(b"".join(map(piece, ids))).encode()
            else:
                yield (b"" if first else b" ") + b" ".join(map(piece, ids))
            first = False
        if self.bytes_mode:
            yield machine.decode(b"", True).encode()


@lru_cache(2)
def _codec(path: str) -> tuple[Encoder, Decoder]:
    table = MergeTable(path)
    return Encoder(table), Decoder(table)


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """The ``keep`` columns with n_tokens, ids_sha256, decoded_sha256 and, on request, the ids themselves.

    One pass over the rows where they are, no shuffle; memory is bounded by a text and MEMO_BYTES, since ids are
    digested block by block (with ``ids``, by the ids of 256 rows). A null or empty text has no tokens. Repeated
    rows give repeated rows; further columns are left out unless named in ``keep``.
    """
    fields = [docs.schema[c] for c in keep]
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    if clash := {*names, "token_ids"} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} clash with the result's")

    def run(batches):
        import pyarrow as pa

        encoder, decoder = _codec(path)
        def watched(blocks, h, counts):
            for b in blocks:
                h.update(b)
                counts.append(len(b) // 4)
                yield b

        for batch in slices(batches):
            out: dict[str, list] = {n: [] for n in names}
            lists = []
            for value in batch.column(batch.num_columns - 1):
                h, d, counts = hashlib.sha256(), hashlib.sha256(), []
                blocks = encoder.encode(value.as_py())
                blocks = list(blocks) if ids else blocks
                for b in decoder.decode(watched(blocks, h, counts)):
                    d.update(b)
                out["n_tokens"].append(sum(counts))
                out["ids_sha256"].append(h.hexdigest())
                out["decoded_sha256"].append(d.hexdigest())
                if ids:
                    lists.append(array("I", b"".join(blocks)).tolist())
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(out["n_tokens"], pa.int64()), *(pa.array(out[n], pa.string()) for n in names[1:])]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(lists, pa.list_(pa.int32()))] * ids, names=[*keep, *names, *["token_ids"] * ids])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["token_ids array<int>"] * ids])
    return with_code(docs).select(*keep, F.col(text).alias("__text")).mapInArrow(run, kinds)
