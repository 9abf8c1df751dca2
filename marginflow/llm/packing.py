"""Packing documents into token sequences by order-preserving dynamic programming.

Documents are encoded where they are; only the places where they may be cut move, each with the number of ids and the
CRC-32 of the ids before it, about a tenth of the text. In order of documents the token stream is dealt into blocks, and
each block's sequences are the cheapest way to cut it: padding, plus a price for each cut within a document, plus a
small one for each sequence. Costs are linear in a sequence's length, so the best start for each end is the least entry of a
monotone queue; lengths that are powers of two, which need no padding, are looked up beside it.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import with_code
from .bpe import MEMO_CHARS, PIECE_CHARS, Encoder, MergeTable
from .common import checkpointed, running, slices

#: Tokens of a sequence.
LENGTH = 2048
#: Tokens of a block; each block is packed by itself, so its last sequence may be short.
BLOCK = 1 << 20
#: Tokens of a document that are one row; a longer document is several, which may go to several blocks.
SEGMENT = 1 << 16
#: A sentence of more tokens may also be cut at each so many.
STRIDE = 256
#: In tokens of padding: prices of a cut between sentences, of one within a sentence, and of a sequence.
SENTENCE_PRICE, WORD_PRICE, SEQUENCE_PRICE = 8, 48, 4
#: Bytes of remembered words in a worker, in two generations; the older one goes when the younger one is full.
MEMO_BYTES = 224 << 20
#: New words that are merged at once, and characters of texts that are looked through for them at once.
MERGED_AT_ONCE, LEARNT_AT_ONCE = 1 << 14, 1 << 20
#: Chunks from one cut to the next at least: shorter sentences stay with the next one.
LEAST_CHUNKS = 4
#: Signs at the end of a sentence's last chunk.
SENTENCE_ENDS = ".!?…。！？"


class Merger:
    """The merges of many short words at once: the words are rows of a matrix, of which each round merges every row's
    best pair. Ranks of pairs are found in a table of hashes with few collisions."""

    def __init__(self, table: MergeTable):
        import numpy as np

        self.made = np.array(table.made, np.int32)
        self.none = len(table.made)
        self.complete = None not in table.inner and None not in table.final
        if self.complete:
            self.inner, self.final = np.array(table.inner, np.int32), np.array(table.final, np.int32)
        self.bits = max(10, (8 * self.none).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int32)
        pairs = np.array([x << 32 | y for x, y in table.ranks], np.int64)
        left = np.arange(len(pairs))
        self.probes = 0
        while len(left):  # each round, of the pairs that want a free place one gets it
            place = self._place(pairs[left], self.probes)
            free = self.keys[place] < 0
            self.keys[place[free]] = pairs[left[free]]
            settled = self.keys[place] == pairs[left]
            self.ranks[place[settled]] = left[settled]
            left, self.probes = left[~settled], self.probes + 1

    def _place(self, keys, probe: int):
        import numpy as np

        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def rank(self, x, y):
        """Ranks of pairs of ids; those of no merge, or with an id below 0, are ``none``."""
        import numpy as np

        keys = np.where((x < 0) | (y < 0), -2, x.astype(np.int64) << 32 | y).ravel()
        place = self._place(keys, 0)
        held = self.keys[place]
        out = np.where(held == keys, self.ranks[place], self.none)
        # a free place ends the search: a pair would have taken it
        left = np.flatnonzero((held != keys) & (held >= 0) & (keys >= 0))
        for probe in range(1, self.probes):
            if not len(left):
                break
            place = self._place(keys[left], probe)
            held = self.keys[place]
            hit = held == keys[left]
            out[left[hit]] = self.ranks[place[hit]]
            left = left[~hit & (held >= 0)]
        return out.reshape(x.shape)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes."""
        import numpy as np

        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        width = int(sizes.max())
        ids = np.full((len(words), width + 1), -1, np.int32)
        ids[:, :width][np.arange(width) < sizes[:, None]] = symbols
        ranks = np.full((len(words), width + 1), self.none, np.int32)
        ranks[:, :width] = self.rank(ids[:, :-1], ids[:, 1:])
        rows, done = np.arange(len(words)), np.full((len(words), width), -1, np.int32)
        columns = np.arange(width)
        while len(rows):
            best = ranks.argmin(1)
            all_rows = np.arange(len(rows))
            least = ranks[all_rows, best]
            going = least < self.none
            if not going.all():
                done[rows[~going]] = ids[~going, :width]
                rows, ids, ranks, best, least = rows[going], ids[going], ranks[going], best[going], least[going]
                all_rows = np.arange(len(rows))
            ids[all_rows, best] = self.made[least]
            # what lies behind the pair moves up
            source = columns + (columns > best[:, None])
            ids[:, :width] = np.take_along_axis(ids, source, 1)
            ranks[:, :width] = np.take_along_axis(ranks, source, 1)
            ranks[all_rows, best] = self.rank(ids[all_rows, best], ids[all_rows, best + 1])
            before = np.maximum(best - 1, 0)
            ranks[all_rows, before] = np.where(best > 0, self.rank(ids[all_rows, before], ids[all_rows, best]), ranks[all_rows, before])
        counts = 4 * (done >= 0).sum(1)
        flat = done[done >= 0].astype(np.uint32).tobytes()
        cuts = [0, *np.cumsum(counts).tolist()]
        return [flat[i:j] for i, j in zip(cuts, cuts[1:])]


class WordEncoder(Encoder):
    """Remembers words as ``Encoder`` does; the new short words of many texts are merged at once."""

    def __init__(self, table: MergeTable):
        super().__init__(table)
        self.merger = Merger(table)

    def read(self, texts: list[str | None]) -> list[list | None]:
        """For each text its pieces as chunks and their ids, those of all texts that are new merged at once; None for
        texts with special tokens or of over LEARNT_AT_ONCE characters, which ``sentences`` reads by itself."""
        out: list[list | None] = []
        every: set[str] = set()
        for text in texts:
            if not text or len(text) > LEARNT_AT_ONCE or not self.merger.complete or self.special and self.special.search(text):
                out.append(None)
                continue
            pieces = [self._normal(piece) for piece in self._pieces(text)]
            every.update(*pieces)
            out.append(pieces)
        memo = self.memo  # ``learn`` may go on with another one, but what it has found is in this one
        found = self.learn(every.difference(memo))
        some_long = len(found) and max(map(len, found)) > MEMO_CHARS
        for pieces in out:
            for k, chunks in enumerate(pieces or ()):
                ids = list(map(memo.get, chunks))
                if some_long:
                    ids = [found[c] if x is None else x for c, x in zip(chunks, ids, strict=True)]
                pieces[k] = chunks, ids
        return out

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """The ids of these chunks, which are remembered."""
        found: dict[str, bytes] = {}
        if self.old:
            found = {c: x for c in new if (x := self.old.get(c)) is not None}
            new = new.difference(found)
        words = {c for c in new if c.isalpha()}
        mixed = list(new.difference(words))
        # a word with one sign behind it is cut as the pattern would have it
        parts = [(c[:-1], c[-1]) if c[-1] in ".,;:!?" and c[:-1].isalpha() and self.table.drops_space else tuple(self._words(c)) for c in mixed]
        words.update(set(chain.from_iterable(parts)).difference(self.memo, found))
        if self.old:
            again = {w: x for w in words if (x := self.old.get(w)) is not None}
            found.update(again)
            words.difference_update(again)
        fresh: list[tuple[list[str], list[bytes]]] = [([], []) for _ in range(3)]
        for word in words:
            n = len(data := word.encode())
            if n > 32:
                found[word] = b"".join(self._long(word))
                continue
            kind, coded = fresh[0 if n <= 8 else 1 if n <= 16 else 2]
            kind.append(word)
            coded.append(data)
        for some, coded in fresh:
            for at in range(0, len(some), MERGED_AT_ONCE):
                found.update(zip(some[at : at + MERGED_AT_ONCE], self.merger.merge(coded[at : at + MERGED_AT_ONCE]), strict=True))
        have, memo = found.get, self.memo
        found.update([(chunk, b"".join([have(w) or memo[w] for w in ws])) for chunk, ws in zip(mixed, parts, strict=True)])
        kept = found if max(map(len, found), default=0) <= MEMO_CHARS else {c: x for c, x in found.items() if len(c) <= MEMO_CHARS}
        self.held += sum(map(len, kept)) + sum(map(len, kept.values())) + 200 * len(kept)  # and the objects' own size
        self.memo.update(kept)
        if 2 * self.held > MEMO_BYTES:
            self.old, self.memo, self.held = self.memo, {}, 0
        return found

    def sentences(self, text: str | None, pieces: list | None = None):
        """The text's ids in blocks of bytes, each with whether a sentence ends there. ``pieces``: what ``read`` made
        of it."""
        if pieces is not None:
            for chunks, ids in pieces:
                yield from self._blocks(chunks, ids)
            return
        if not text:
            return
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield self.table.added[part].to_bytes(4, "little"), False
                continue
            for piece in self._pieces(part):
                chunks, get = self._normal(piece), self.memo.get
                if len(piece) > 2 * PIECE_CHARS:  # without white space for long
                    for c in chunks:
                        yield from ((b, False) for b in self._long(c))
                    continue
                yield from self._blocks(chunks, [get(c) or self._chunk(c) for c in chunks])

    def _blocks(self, chunks: list[str], ids: list[bytes]):
        at = 0
        for i in [i for i, c in enumerate(chunks, 1) if c[-1] in SENTENCE_ENDS]:
            if i - at >= LEAST_CHUNKS:
                yield b"".join(ids[at:i]), True
                at = i
        if at < len(ids):
            yield b"".join(ids[at:]), chunks[-1][-1] in SENTENCE_ENDS


def cut_places(sentences, end: int, stride: int = STRIDE) -> tuple[int, list[int], list[int]]:
    """Of one document: its number of ids, with the id ``end`` after them; places where it may be cut, as ids before
    them, negative if within a sentence; and the CRC-32 of the ids before each. The last place is the document's end. Neighbouring places are at most 2 * ``stride`` + 1 ids apart."""
    n = crc = since = 0
    places: list[int] = []
    crcs: list[int] = []
    for data, ends in sentences:
        m = len(data) >> 2
        if since + m > 2 * stride:
            at = 0
            while m - at > stride:
                step = max(1, stride - since)
                crc = zlib.crc32(data[4 * at : 4 * (at + step)], crc)
                at += step
                since = 0
                places.append(-(n + at))
                crcs.append(crc)
            crc = zlib.crc32(data[4 * at :], crc)
            since = m - at
        else:
            crc = zlib.crc32(data, crc)
            since += m
        n += m
        if ends and since:
            places.append(n)
            crcs.append(crc)
            since = 0
    if places and abs(places[-1]) == n:  # no cut before the last id
        places.pop()
        crcs.pop()
    places.append(n + 1)
    crcs.append(zlib.crc32(end.to_bytes(4, "little"), crc))
    return n + 1, places, crcs


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(MergeTable(path))


def encoded(encoder: WordEncoder, texts):
    """The sentences of each text, of which so many are read at a time as hold LEARNT_AT_ONCE characters."""
    held: list[str | None] = []
    size = 0
    for value in texts:
        text = value.as_py()
        if size + len(text or "") > LEARNT_AT_ONCE and held:
            yield from map(encoder.sentences, held, encoder.read(held))
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    yield from map(encoder.sentences, held, encoder.read(held))


def segments(docs: DataFrame, path: str, end: int = 1, stride: int = STRIDE, text: str = "text") -> DataFrame:
    """(doc_id, row, seg, start, length, doc_tokens, crc, places, crcs): each document's places to cut, in rows of up to
    about SEGMENT tokens. ``crc`` is that of the ids before ``start``; ``row`` tells documents of equal ids apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(path)
        names = ["doc_id", "row", "seg", "start", "length", "doc_tokens", "crc", "places", "crcs"]
        kinds = [None, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in slices(batches):
            out: list[list] = [[] for _ in names]
            owner = []
            for i, (row, sentences) in enumerate(zip(batch.column(1).to_pylist(), encoded(encoder, batch.column(2)), strict=True)):
                n, places, crcs = cut_places(sentences, end, stride)
                start = begun = crc = seg = 0
                for k, place in enumerate(places):
                    if k + 1 == len(places) or abs(places[k + 1]) - start > SEGMENT:
                        stop = abs(place)
                        owner.append(i)
                        for column, x in zip(out[1:], (row, seg, start, stop - start, n, crc, places[begun : k + 1], crcs[begun : k + 1]), strict=True):
                            column.append(x)
                        start, begun, crc, seg = stop, k + 1, crcs[k], seg + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(out[1:], kinds[1:], strict=True))], names=names)

    rows = with_code(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"doc_id {kind}, row long, seg int, start long, length long, doc_tokens long, crc long, places array<long>, crcs array<long>")


def best_cuts(at: list[int], price: list[int], length: int = LENGTH) -> list[int]:
    """Indices of the places where sequences end, the last place included. ``at``: places in ascending order, the first
    of them the start; ``price``: of ending a sequence there. Neighbours are at most ``length`` apart. Of equally cheap
    ways the one with the longest last sequence is taken, and so on backwards."""
    import numpy as np

    m = len(at)
    places = np.asarray(at, np.int64)
    exact: dict[int, list[int]] = {}
    of = np.full(at[-1] - at[0] + 1, -1, np.int32)  # the place at each id
    of[places - at[0]] = np.arange(m)
    size = 1
    while size < length:
        later = int(np.searchsorted(places, at[0] + size))  # places that lie so far behind the first
        found = of[places[later:] - at[0] - size]
        for j in np.flatnonzero(found >= 0).tolist():
            exact.setdefault(later + j, []).append(int(found[j]))
        size *= 2
    cost, came = [0] * m, [0] * m
    queue = deque([(at[0], 0)])  # (cost + place, index), both ascending
    for j in range(1, m):
        here = at[j]
        while at[queue[0][1]] < here - length:
            queue.popleft()
        key, i = queue[0]
        least = key + length - here
        for e in reversed(exact.get(j, ())):  # the longest first
            if cost[e] < least or cost[e] == least and e < i:
                least, i = cost[e], e
        cost[j], came[j] = least + price[j], i
        key = cost[j] + here
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    out, j = [], m - 1
    while j > 0:
        out.append(j)
        j = came[j]
    return out[::-1]


@lru_cache(64)
def _zeros(n: int) -> tuple:
    """Tables that tell what a CRC-32 becomes as ``n`` bytes follow it, by each of its four bytes."""
    import numpy as np

    zeros = bytes(n)
    none = zlib.crc32(zeros)
    return tuple(np.array([zlib.crc32(zeros, b << 8 * k) ^ none for b in range(256)], np.uint32) for k in range(4))


def crc_of_rest(whole, head, ids, most: int = LENGTH):
    """CRC-32 of the last ``ids`` (at most ``most``) ids of a sequence from its own and that of the ids before them."""
    import numpy as np

    c = np.asarray(head, np.uint32)
    ids = np.asarray(ids, np.int64)
    for k in range(most.bit_length()):
        t = _zeros(4 << k)
        c = np.where(ids >> k & 1, t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24], c)
    return np.asarray(whole, np.uint32) ^ c


def pack(docs: DataFrame, path: str, end: int = 1, length: int = LENGTH, block: int = BLOCK, text: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``padding`` of its sequence.

    Documents, in order of doc_id (null first; equal ones in order of their rows), become one stream of ids, each
    followed by the id ``end``; a null or empty text is that id alone. The stream is dealt into blocks of about
    ``block`` ids and each block is cut into sequences of at most ``length`` ids, at the least total of padding and
    prices. A sequence is padded to ``length`` unless its size is a power of two. Sequence ids ascend with the stream,
    with gaps between blocks. Documents of any length are cut; further columns are not read; an empty table gives no
    rows.
    """
    from pyspark.sql import types as T

    if length < 8:
        raise ValueError("sequences hold at least 8 ids")
    # written first, so that finding the ranges of documents does not encode them a second time
    found = checkpointed(segments(docs, path, end, min(STRIDE, (length - 1) // 2), text))
    order = [F.col("doc_id").asc_nulls_first(), F.col("row"), F.col("seg")]
    placed = running(found, order, {"until": "length"}, rank="at")
    placed = placed.withColumn("block", F.floor((F.col("until") - F.col("length")) / block).cast("long"))
    kind = docs.schema["doc_id"].dataType
    result = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding")])

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("at").combine_chunks()
        if not table.num_rows:
            return pa.table({f.name: [] for f in result})
        column = lambda n: table.column(n).to_numpy()
        rows, starts, crc0 = column("row"), column("start"), column("crc")
        lists = table.column("places").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(table.num_rows), sizes)
        signed, crcs = lists.flatten().to_numpy(), table.column("crcs").combine_chunks().flatten().to_numpy()
        inside = np.abs(signed)
        before = np.concatenate([[0], np.cumsum(column("length"))])[:-1]
        at = np.concatenate([[0], before[owner] + inside - starts[owner]])
        is_end = inside == column("doc_tokens")[owner]
        price = np.where(is_end, 0, np.where(signed < 0, WORD_PRICE, SENTENCE_PRICE)) + SEQUENCE_PRICE
        cuts = np.array(best_cuts(at.tolist(), [0, *price.tolist()], length), np.int64)
        # pieces end at cuts and where documents do; they begin where the one before ended, or their document does here
        ends = np.union1d(cuts, np.flatnonzero(is_end) + 1) - 1
        own = owner[ends]
        fresh = np.concatenate([[True], rows[own][1:] != rows[own][:-1]])
        last = np.concatenate([[0], ends[:-1]])
        # a document's first row in this block
        first_row = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        home = first_row[np.searchsorted(first_row, own, "right") - 1]
        start = np.where(fresh, starts[home], inside[last])
        size = inside[ends] - start
        crc = crc_of_rest(crcs[ends], np.where(fresh, crc0[home], crcs[last]), size, length)
        sequence = np.searchsorted(cuts, ends + 1)
        begin = at[np.concatenate([[0], cuts[:-1]])]
        fill = at[cuts] - begin
        padding = np.where(fill & (fill - 1), length - fill, 0)
        number = int(table.column("block")[0].as_py()) * (4 * max(block, SEGMENT)) + sequence
        columns = [table.column("doc_id").combine_chunks().take(pa.array(own)), *map(pa.array, (start, size, crc.astype(np.int64), column("doc_tokens")[own], number, at[ends + 1] - size - begin[sequence], padding[sequence]))]
        return pa.table(dict(zip([f.name for f in result], columns, strict=True)))

    return placed.groupBy("block").applyInArrow(run, result)
