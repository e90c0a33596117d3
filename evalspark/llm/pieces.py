"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut where no piece of the vocabulary can cross, and each
distinct unit is kept once. The units are concatenated and indexed by a suffix
array as deep as the longest piece. A binary search for every piece gives the
range of suffixes that begin with it, hence all its occurrences; each becomes an
edge from its first place to the place after its last. Edges are put in order of
position, and relaxed: for a unigram vocabulary by the best sum of scores, for a
BPE vocabulary in merge order, where two neighbours may merge if an edge spans
both, the best-scored edge of a unit first and the leftmost of equal ones.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches
from .words import pieces as portions

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
NONE = np.int32(2**31 - 1)
#: Distinct units that a task remembers between batches, and characters indexed at once.
REMEMBERED, INDEXED = 400_000, 1 << 20
#: Units longer than this are relaxed one at a time with a heap.
LONG = 2048


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id with scores; special ids match no text; ``byte_ids`` cover characters without a piece."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    matches: tuple[bool, ...]
    byte_ids: tuple[int, ...] | None
    unknown: int
    kind: str
    prefix: bool = True


def load(path: str = MODEL) -> Vocabulary:
    """Read a model file on the driver; executors get the vocabulary, not the path.

    A model whose library encodes any of PROBES otherwise than ``Encoder`` is an error.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.get_piece_size())
    names = tuple(p.id_to_piece(i) for i in ids)
    special = [p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) for i in ids]
    byte_ids = tuple(i for i in ids if p.is_byte(i))
    scores = tuple(p.get_score(i) for i in ids)
    live = [s for s, x in zip(scores, special, strict=True) if not x]
    # A BPE model's scores count merges down from zero; a unigram model's are log probabilities.
    kind = "bpe" if all(float(s).is_integer() for s in live) else "unigram"
    prefix = len(p.encode("a")) == 1 and p.id_to_piece(p.encode("a")[0]).startswith(SPACE)
    v = Vocabulary(names, scores, tuple(not x for x in special), byte_ids if len(byte_ids) == 256 else None, p.unk_id(), kind, prefix)
    offsets, flat = Encoder(v).encode(list(PROBES))
    for t, x, y in zip(PROBES, offsets, offsets[1:], strict=False):
        if flat[x:y].tolist() != p.encode(t):
            raise ValueError(f"{path} changes or cuts texts in a way that is not supported: {t!r}")
    return v


#: Texts that tell models apart which normalise characters, fold case or spaces, or were trained in another manner.
PROBES = (
    "The quick brown fox", "  two  spaces ", "\ttab\nline\r\n", "ﬁ Ａ ½ ²", "e\u0301 é Å \u212b", "\u00a0x\u2003y\u3000z", "UPPER lower İı ß", "日本語 한국어 🎉", "x\u200by \ufeff", "12345 3.14 a_b-c/d", "aaaaaaaaaaaa", "\u2581x",
)


class Encoder:
    """Encodes texts with one vocabulary; units met before in the same task are remembered."""

    def __init__(self, v: Vocabulary):
        self.v = v
        live = [i for i, m in enumerate(v.matches) if m]
        self.ids = np.array(live, np.int32)
        names = [v.pieces[i] for i in live]
        self.alphabet = {c: k + 1 for k, c in enumerate(sorted({c for x in names for c in x}))}
        self.longest = max(map(len, names), default=1)
        width = 4
        while width < self.longest:
            width *= 2
        self.width = width
        codes = np.zeros((len(names), width), np.uint64)
        high = np.full((len(names), width), 0xFFFF, np.uint64)
        for i, x in enumerate(names):
            codes[i, : len(x)] = high[i, : len(x)] = [self.alphabet[c] for c in x]
        self.lengths = np.array([len(x) for x in names], np.int32)
        pack = np.array([48, 32, 16, 0], np.uint64)
        self.low = np.bitwise_or.reduce(codes.reshape(len(names), -1, 4) << pack, axis=2)
        self.high = np.bitwise_or.reduce(high.reshape(len(names), -1, 4) << pack, axis=2)
        order = sorted(range(len(live)), key=lambda k: (-v.scores[live[k]], live[k]))
        self.rank = np.empty(len(live) + 1, np.int32)
        self.rank[0] = NONE
        #: Equal scores rank equally: then the leftmost edge goes first.
        rank = -1
        for j, k in enumerate(order):
            rank += j == 0 or v.scores[live[k]] != v.scores[live[order[j - 1]]]
            self.rank[k + 1] = rank
        self.score = np.array([0.0, *(v.scores[i] for i in live)])
        self.unknown_score = min((v.scores[i] for i in live), default=0.0) - 10.0
        crossing = any(SPACE in x.lstrip(SPACE) for x in names)
        loose = "" if "\n" in self.alphabet else "\n"
        self.cut = re.compile(f"{loose}|{SPACE}+[^{SPACE}{loose}]*|[^{SPACE}{loose}]+" if loose else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if not crossing else re.compile("(?s).+")
        self.known: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.empty(0, np.int32)

    # -- suffix array ---------------------------------------------------------

    def _edges(self, codes: np.ndarray) -> np.ndarray:
        """For each place and piece length, 1 + the index of the piece that starts there; 0 for none."""
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(self.width, np.uint16)]).astype(np.uint64)
        key = (padded[:n] << np.uint64(48)) | (padded[1 : n + 1] << np.uint64(32)) | (padded[2 : n + 2] << np.uint64(16)) | padded[3 : n + 3]
        low, high, w = self.low, self.high, 4
        while True:
            distinct, rank = np.unique(key, return_inverse=True)
            lo, hi = np.searchsorted(distinct, low, "left"), np.searchsorted(distinct, high, "right")
            if w == self.width:
                break
            after = np.zeros(n, np.uint64)
            after[: n - w] = rank[w:].astype(np.uint64) + np.uint64(1)
            key = (rank.astype(np.uint64) << np.uint64(32)) | after
            #: Halves that match nothing give an empty range; past the end of the text stands rank 0.
            empty = (lo[:, 0::2] >= hi[:, 0::2]) | (lo[:, 1::2] >= hi[:, 1::2])
            free = self._free(w)
            one = (lo[:, 0::2].astype(np.uint64) << np.uint64(32)) | np.where(free, 0, lo[:, 1::2] + 1).astype(np.uint64)
            two = ((np.maximum(hi[:, 0::2], 1) - 1).astype(np.uint64) << np.uint64(32)) | hi[:, 1::2].astype(np.uint64)
            low, high = np.where(empty, np.uint64(2**64 - 1), one), np.where(empty, np.uint64(0), two)
            w *= 2
        suffixes = np.argsort(rank, kind="stable")
        count = np.concatenate(([0], np.cumsum(np.bincount(rank, minlength=len(distinct)))))
        first, last = count[np.minimum(lo[:, 0], len(distinct))], count[np.minimum(hi[:, 0], len(distinct))]
        times = np.maximum(last - first, 0)
        piece = np.repeat(np.arange(len(times)), times)
        at = suffixes[np.repeat(first - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())]
        # Placing each edge by start and length is a counting sort by position.
        table = np.zeros((n, self.longest), np.int32)
        table[at, self.lengths[piece] - 1] = piece + 1
        return table

    def _free(self, w: int) -> np.ndarray:
        """Whether the second half of each 2w-wide part lies wholly beyond a piece's end."""
        ends = np.arange(self.width // (2 * w)) * 2 * w + w
        return self.lengths[:, None] <= ends[None, :]

    # -- relaxation -----------------------------------------------------------

    def _merge(self, table: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token starts and the token's edge (1 + piece, or 0) of all units, in merge order."""
        n = int(sizes.sum())
        unit = np.repeat(np.arange(len(sizes)), sizes)
        starts, stops = np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
        done: list[np.ndarray] = []
        long = np.flatnonzero(sizes > LONG)
        if len(long):
            begin = np.concatenate(([0], np.cumsum(sizes)))
            done += [self._merge_long(table, int(begin[u]), int(begin[u + 1])) for u in long]
            short = ~np.isin(unit, long)
            starts, stops, unit = starts[short], stops[short], unit[short]
        while len(starts):
            length = np.empty(len(starts), np.int64)
            length[:-1] = stops[1:] - starts[:-1]
            length[-1] = self.longest + 1
            length[:-1][unit[1:] != unit[:-1]] = self.longest + 1
            fits = length <= self.longest
            rank = np.full(len(starts), NONE, np.int32)
            rank[fits] = self.rank[table[starts[fits], length[fits] - 1]]
            heads = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            best = np.minimum.reduceat(rank, heads)
            each = np.repeat(best, np.diff(np.concatenate((heads, [len(starts)]))))
            live = each < NONE
            done.append(starts[~live])
            hit = np.flatnonzero(live & (rank == each))
            hit = hit[np.concatenate(([True], unit[hit][1:] != unit[hit][:-1]))] if len(hit) else hit
            stops[hit] = stops[hit + 1]
            live[hit + 1] = False
            starts, stops, unit = starts[live], stops[live], unit[live]
        return self._closed(table, np.sort(np.concatenate([*done, np.empty(0, np.int64)])), n)

    def _merge_long(self, table: np.ndarray, begin: int, end: int) -> np.ndarray:
        after, before = list(range(1, end - begin + 1)), list(range(-1, end - begin - 1))
        alive, last, heap = [True] * (end - begin), end - begin, []

        def offer(a: int) -> None:
            b = after[a]
            if b < last and after[b] - a <= self.longest and (r := int(self.rank[table[begin + a, after[b] - a - 1]])) != NONE:
                heapq.heappush(heap, (r, a, after[b]))

        for a in range(last):
            offer(a)
        while heap:
            _, a, stop = heapq.heappop(heap)
            if not alive[a] or after[a] >= last or after[after[a]] != stop:
                continue
            alive[after[a]] = False
            after[a] = stop
            if stop < last:
                before[stop] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return np.flatnonzero(alive) + begin

    def _best(self, table: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token starts and edges of the paths with the best sums of scores; of equal ones the longest last edge."""
        n = int(sizes.sum())
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        value, back = np.full(n + len(sizes), -np.inf), np.zeros(n + len(sizes), np.int32)
        node = np.arange(n) + np.repeat(np.arange(len(sizes)), sizes)
        value[begin + np.arange(len(sizes))] = 0.0
        for p in range(int(sizes.max(initial=0))):
            at = begin[sizes > p] + p
            room = sizes[sizes > p] - p
            for length in range(1, self.longest + 1):
                edge = table[at, length - 1]
                ok = (room >= length) & ((edge > 0) | (length == 1))
                got = value[node[at[ok]]] + np.where(edge[ok] > 0, self.score[edge[ok]], self.unknown_score)
                to = node[at[ok]] + length
                better = got >= value[to]
                value[to[better]], back[to[better]] = got[better], length
        starts, stop = [], begin + np.arange(len(sizes)) + sizes
        floor = begin + np.arange(len(sizes))
        while len(stop):
            live = stop > floor
            stop, floor = stop[live], floor[live]
            stop = stop - back[stop]
            starts.append(stop)
        at = np.sort(np.concatenate([*starts, np.empty(0, np.int64)]))
        return self._closed(table, np.searchsorted(node, at), n)

    def _closed(self, table: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return starts, table[starts, np.diff(np.concatenate((starts, [n]))) - 1] if len(starts) else np.empty(0, np.int32)

    # -- encoding -------------------------------------------------------------

    def _learn(self, units: list[str]) -> None:
        """Encode new units and remember them."""
        for a, b in portions(units, len, INDEXED):
            text, sizes = "".join(units[a:b]), np.array([len(u) for u in units[a:b]], np.int64)
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            distinct, inverse = np.unique(points, return_inverse=True)
            codes = np.array([self.alphabet.get(chr(c), 0) for c in distinct], np.uint16)[inverse]
            # A zero stands between units, so that no piece is found across two of them.
            spaced = np.zeros(len(codes) + len(sizes), np.uint16)
            place = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)
            spaced[place] = codes
            table = self._edges(spaced)[place]
            starts, edge = (self._merge if self.v.kind == "bpe" else self._best)(table, sizes)
            owner = np.searchsorted(np.cumsum(sizes), starts, "right")
            ids = np.where(edge > 0, self.ids[np.maximum(edge, 1) - 1], -1)
            counts = np.bincount(owner, minlength=len(sizes))
            lost = np.flatnonzero(edge == 0)
            if len(lost):
                parts = [np.array(self._bytes(text[s]), np.int32) for s in starts[lost].tolist()]
                extra = np.array([len(p) for p in parts])
                counts += np.bincount(owner[lost], extra - 1, minlength=len(sizes)).astype(np.int64)
                times = np.ones(len(ids), np.int64)
                times[lost] = extra
                spread, into = np.repeat(ids, times), np.cumsum(times) - times
                spread[np.repeat(into[lost], extra) + np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)] = np.concatenate(parts)
                ids = spread
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def _bytes(self, char: str) -> list[int]:
        if self.v.byte_ids is None:
            return [self.v.unknown]
        return [self.v.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts; a null or empty text has none."""
        if len(self.known) > REMEMBERED:
            self.known, self.starts, self.flat = {}, np.zeros(1, np.int64), np.empty(0, np.int32)
        known, new = self.known, len(self.known)
        sizes, at = [], []
        for t in texts:
            units = self.cut.findall((SPACE if self.v.prefix else "") + t.replace(" ", SPACE)) if t else []
            sizes.append(len(units))
            at += [known.setdefault(u, len(known)) for u in units]
        if len(known) > new:
            self._learn(list(known)[new:])
        at = np.array(at, np.int64)
        count = (self.starts[1:] - self.starts[:-1])[at] if len(at) else np.empty(0, np.int64)
        total = np.concatenate(([0], np.cumsum(count)))
        flat = self.flat[np.repeat(self.starts[at] - total[:-1], count) + np.arange(total[-1])] if len(at) else np.empty(0, np.int32)
        return total[np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)], flat


class Decoder:
    def __init__(self, v: Vocabulary):
        self.prefix = v.prefix
        at = {i: b for b, i in enumerate(v.byte_ids or ())}
        self.raw = [bytes([at[i]]) if i in at else (v.pieces[i].replace(SPACE, " ").encode() if m else b"") for i, m in enumerate(v.matches)]

    def decode(self, ids: list[int]) -> str:
        """Pieces and byte pieces to text; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _plain(model: str | Vocabulary) -> tuple:
    """The vocabulary in built-in types only, which a broadcast can carry to any executor."""
    v = load(model) if isinstance(model, str) else model
    return v.pieces, v.scores, v.matches, v.byte_ids, v.unknown, v.kind, v.prefix


def _parts(texts: list[str | None]):
    yield from portions(texts, lambda t: len(t or ""), 1 << 22)


def encode(docs: DataFrame, model: str | Vocabulary = MODEL) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, ids array<int>``, one row per input row.

    A null text has null ids, an empty one none. Text is encoded whole, whatever
    its length; characters without a piece become byte pieces, or the unknown id
    if the vocabulary has none. Repeated rows are answered each; other columns
    are not read; an empty table gives an empty table.
    """
    return _run(docs, model, _encoder, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | Vocabulary = MODEL) -> DataFrame:
    """``encoded(doc_id, ids array<int>)`` -> ``doc_id, text``; null ids give a null text."""
    bounded_batches(encoded.sparkSession)
    v = encoded.sparkSession.sparkContext.broadcast(_plain(model))

    def go(batches):
        decoder = Decoder(Vocabulary(*v.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if i is None else decoder.decode(i) for i in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(go, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | Vocabulary = MODEL) -> DataFrame:
    """Digests of each text's encoding and of what it decodes to.

    ``doc_id, n_chars, n_pieces, ids_sha256`` (of the ids as little-endian 32-bit
    integers), ``decoded_crc32`` (UTF-8) and ``exact``: whether decoding gives the
    text back. A null text is an empty one. Edge cases are those of ``encode``.
    """
    return _run(docs, model, _tripper, "doc_id long, n_chars long, n_pieces long, ids_sha256 string, decoded_crc32 long, exact boolean")


def _run(docs: DataFrame, model: str | Vocabulary, maker, schema: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    v = docs.sparkSession.sparkContext.broadcast(_plain(model))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(maker(v), schema)


def _encoder(v):
    def go(batches):
        encoder = Encoder(Vocabulary(*v.value))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _parts(texts):
                offsets, flat = encoder.encode(texts[a:b])
                held = pa.array([t is None for t in texts[a:b]], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), mask=held)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], names=["doc_id", "ids"])

    return go


def _tripper(v):
    def go(batches):
        encoder, decoder = Encoder(Vocabulary(*v.value)), Decoder(Vocabulary(*v.value))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _parts(texts):
                offsets, flat = encoder.encode(texts[a:b])
                rows = []
                for i, t in enumerate(texts[a:b]):
                    ids = flat[offsets[i] : offsets[i + 1]]
                    back = decoder.decode(ids.tolist())
                    rows.append((len(t or ""), len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == (t or "")))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], names=["doc_id", "n_chars", "n_pieces", "ids_sha256", "decoded_crc32", "exact"])

    return go
