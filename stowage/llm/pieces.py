"""SentencePiece encoding and decoding by unigram Viterbi over a double-array trie.

The best segmentation of a text has the greatest sum of piece scores. Pieces
are looked up in a double-array trie of their bytes; a character without a
piece of its own falls back to byte pieces at the least score minus a penalty.
A space is the marker U+2581 inside pieces and one is put before the text;
decoding turns markers back and drops that first one. In the trie the marker
is the byte FF, which UTF-8 never uses, so a text's own U+2581 comes back too.

No piece of the vocabulary has a marker after another character (others are
refused), so the units between markers are segmented by themselves, once each,
many side by side. The work is linear in the text, however long a unit is.

A model file of merges has no log scores but ranks (0, -1, -2, ...), whose sums
mean nothing. log_scores() then gives each piece the log probability that
Zipf's law has for its rank. Nothing is trained.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import text_slices

MARK, PENALTY = b"\xff", 10.0
#: Units that a worker remembers, characters of a unit up to which units go side by side and are remembered, units and bytes at a time.
CACHE, WIDE, MANY, CHUNK = 400_000, 48, 20_000, 1 << 18
_END = 256  # stands after each unit; no piece goes on with it


@dataclass
class Trie:
    """Double array: the child of state s by byte c is base[s] + c + 1 if check[there] == s. piece: its id, or -1."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray

    @staticmethod
    def build(keys: dict[bytes, int]) -> Trie:
        tree: list[dict[int, int]] = [{}]
        ends = {}
        for key, value in keys.items():
            at = 0
            for c in key:
                if c not in tree[at]:
                    tree[at][c] = len(tree)
                    tree.append({})
                at = tree[at][c]
            ends[at] = value
        size = 2 * len(tree) + 1024
        base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        used = bytearray(size)
        used[0] = 1
        queue, low, wide, full = deque([(0, 0)]), 257, 257, 0  # before that a slot could fit no base
        while queue:
            node, state = queue.popleft()
            piece[state] = ends.get(node, -1)
            if not (children := tree[node]):
                continue
            codes = sorted(children)
            while used[low]:
                low += 1
            b, tries = max((low if len(codes) == 1 else wide) - codes[0] - 1, 0), 0
            while any(used[b + c + 1] for c in codes):
                b, tries = b + 1, tries + 1
                if b + 300 > len(used):
                    used.extend(bytes(size))
                    base, check, piece = (np.concatenate([a, np.full(size, v, np.int32)]) for a, v in ((base, 0), (check, -1), (piece, -1)))
            if tries > 40:  # a crowded stretch: later branching nodes start behind it
                wide = b
            base[state] = b
            for c in codes:
                used[b + c + 1] = 1
                check[b + c + 1] = state
                full = max(full, b + c + 1)
                queue.append((children[c], b + c + 1))
        end = full + 258
        return Trie(base[:end].copy(), np.pad(check, (0, max(0, end - len(check))), constant_values=-1)[:end].copy(), piece[:end].copy())

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is none."""
        to = self.base[states] + codes + 1
        return np.where((states >= 0) & (self.check[to] == states), to, -1)


def log_scores(scores: list[float], usable: list[bool]) -> np.ndarray:
    """The scores themselves if they can be log probabilities of the usable pieces; else, by Zipf's law, those of their order."""
    known, use = np.array(scores, np.float64), np.array(usable, bool)
    if not use.any() or (known[use].max() <= 0 and 0.5 <= np.exp(known[use]).sum() <= 1.01):
        return known
    order = np.flatnonzero(use)[np.argsort(-known[use], kind="stable")]
    ranks = np.arange(1, len(order) + 1)
    known[order] = -np.log(ranks) - np.log((1 / ranks).sum())
    return known


@dataclass
class Vocabulary:
    trie: Trie
    scores: np.ndarray
    text: list[bytes]  # bytes that a piece stands for, the marker as FF
    bytes_at: np.ndarray  # id of each byte's piece
    fallback: float

    @staticmethod
    def load(path: str | None = None) -> Vocabulary:
        """Pieces and log scores of a SentencePiece model file; its own trainer's kind of model does not matter."""
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        is_byte = [model.is_byte(i) for i in range(n)]
        scores = log_scores([model.get_score(i) for i in range(n)], [not a and not b for a, b in zip(special, is_byte, strict=True)])
        return Vocabulary.of(pieces, scores.tolist(), special, is_byte)

    @staticmethod
    def of(pieces: list[str], scores: list[float], special: list[bool], is_byte: list[bool]) -> Vocabulary:
        text, keys, bytes_at = [], {}, np.full(256, -1, np.int32)
        for i, (p, no, byte) in enumerate(zip(pieces, special, is_byte, strict=True)):
            raw = b"" if no else bytes([int(p[3:5], 16)]) if byte else p.encode().replace("▁".encode(), MARK)
            text.append(raw)
            if byte:
                bytes_at[raw[0]] = i
            elif raw:
                keys.setdefault(raw, i)
                if MARK in raw.lstrip(MARK):
                    raise ValueError(f"piece {i} has a marker after another character")
        if (bytes_at < 0).any():
            raise ValueError("the vocabulary has no piece for some byte")
        known = np.array(scores, np.float64)
        return Vocabulary(Trie.build(keys), known, text, bytes_at, float(min((known[i] for i in keys.values()), default=0.0)) - PENALTY)


_SEGMENTERS: dict[int, Segmenter] = {}


def segmenter(vocabulary: Vocabulary) -> Segmenter:
    """One for each worker process and vocabulary, so that its units serve all of the worker's tasks."""
    key = zlib.crc32(vocabulary.scores.tobytes(), zlib.crc32(b"\0".join(vocabulary.text)))
    if key not in _SEGMENTERS:
        _SEGMENTERS.clear()
        _SEGMENTERS[key] = Segmenter(vocabulary)
    return _SEGMENTERS[key]


class Segmenter:
    """Ids of texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, {}
        self.reach = max(4, max(map(len, vocabulary.text)))

    def units(self, raws: list[bytes]) -> list[bytes]:
        """Ids, as 32-bit bytes, of each unit by Viterbi. Of equal sums the one whose last piece is longest is taken."""
        out: list[bytes] = []
        for i in range(0, len(raws), MANY):
            part = raws[i : i + MANY]
            out += self._segment(b"".join(part), np.array([len(r) for r in part]), self._side_by_side)
        return out

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and id (-1: bytes of a character without a piece) of every piece that fits anywhere."""
        trie = self.v.trie
        at = np.flatnonzero((codes != _END) & ((codes & 0xC0) != 0x80) | (codes == 0xFF))  # a character or marker begins here
        first = codes[at]
        after = at + np.select([first < 0x80, first >= 0xFF, first >= 0xF0, first >= 0xE0], [1, 1, 4, 3], 2)
        single = np.zeros(len(codes), bool)
        size = np.zeros(len(codes), np.int64)
        size[at] = after - at
        starts, ends, ids = [], [], []
        cur, states = at, np.zeros(len(at), np.int64)
        while len(cur):
            states = trie.step(states, codes[cur])
            alive = states >= 0
            at, cur, states = at[alive], cur[alive] + 1, states[alive]
            piece = trie.piece[states]
            hit = piece >= 0
            s, e = at[hit], cur[hit]
            single[s[e - s == size[s]]] = True
            starts.append(s)
            ends.append(e)
            ids.append(piece[hit])
        lone = np.flatnonzero((size > 0) & ~single)
        return np.concatenate([*starts, lone]), np.concatenate([*ends, lone + size[lone]]), np.concatenate([*ids, np.full(len(lone), -1)])

    def _segment(self, raw: bytes, lengths: np.ndarray, paths: Callable) -> list[bytes]:
        """Ids of the units that lie one after another in raw. paths: _side_by_side or _one_by_one."""
        v = self.v
        codes = np.full(len(raw) + len(lengths), _END, np.int32)
        begin = np.cumsum(lengths + 1) - lengths - 1
        codes[np.arange(len(raw)) + np.repeat(np.arange(len(lengths)), lengths)] = np.frombuffer(raw, np.uint8)
        back, via = paths(codes, begin)
        chosen = np.zeros(len(codes), bool)
        at = (begin + lengths)[lengths > 0]
        while len(at):
            chosen[at] = True
            at = back[at]
            at = at[back[at] >= 0]
        e = np.flatnonzero(chosen)
        s, ids = back[e], via[e]
        count = np.where(ids >= 0, 1, e - s)
        flat = np.repeat(ids, count)
        place = np.repeat(s, count) + np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
        flat = np.where(flat >= 0, flat, v.bytes_at[np.minimum(codes[place], 255)]).astype("<i4").tobytes()
        total = np.append(0, np.cumsum(count))
        ends = (4 * total[np.searchsorted(e, begin + lengths, "right")]).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _side_by_side(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place where the last piece of its best path begins (-1: nowhere), and that piece. All units advance together."""
        s, e, ids = self._edges(codes)
        unit = np.zeros(len(codes), np.int64)
        unit[begin[1:]] = 1
        far = e - begin[np.cumsum(unit)[s]]
        order = np.argsort((far * len(codes) + e) * len(codes) + s)
        s, e, ids, far = s[order], e[order], ids[order], far[order]
        score = np.where(ids >= 0, self.v.scores[ids], self.v.fallback)
        best, back, via = np.zeros(len(codes)), np.full(len(codes), -1, np.int64), np.full(len(codes), -1, np.int64)
        at = np.searchsorted(far, np.arange(1, int(far.max(initial=0)) + 2))
        for i, j in zip(at, at[1:], strict=False):
            if i == j:
                continue
            ends = e[i:j]
            heads = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
            sums = best[s[i:j]] + score[i:j]
            top = np.maximum.reduceat(sums, heads)
            equal = np.flatnonzero(sums == np.repeat(top, np.diff(np.append(heads, j - i))))
            took = i + equal[np.searchsorted(equal, heads)]
            best[ends[heads]], back[ends[heads]], via[ends[heads]] = top, s[took], ids[took]
        return back, via

    def _one_by_one(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for few, long units: edge by edge and window by window, in time linear in the text."""
        n, reach = len(codes), self.reach
        best, back, via = [-math.inf] * n, np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for i in begin.tolist():
            best[i] = 0.0
        for w in range(0, n, CHUNK):
            s, e, ids = self._edges(np.append(codes[w : w + CHUNK + reach], _END))
            order = np.lexsort((e, s))
            order = order[s[order] < CHUNK]
            s, e, ids = s[order] + w, e[order] + w, ids[order]
            score = np.where(ids >= 0, self.v.scores[ids], self.v.fallback)
            took: dict[int, int] = {}
            for k, (i, j, x) in enumerate(zip(s.tolist(), e.tolist(), score.tolist(), strict=True)):
                if (total := best[i] + x) > best[j]:
                    best[j], took[j] = total, k
            at, last = np.fromiter(took, np.int64, len(took)), np.fromiter(took.values(), np.int64, len(took))
            back[at], via[at] = s[last], ids[last]
        return back, via

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        split = []
        for t in texts:
            if not t:
                split.append([])
            elif "  " in t or t[0] == " ":
                # A unit is all markers before a word; one marker is not written, so units are words as below.
                split.append([u[1:] if u[1:2] != " " else u for u in re.findall(" +[^ ]*", " " + t)])
            else:
                split.append(t.split(" "))
        new = set().union(*split).difference(self.known)
        plain = [u for u in new if len(u) <= WIDE and u[:1] != " "]
        for i in range(0, len(plain), MANY):
            part = plain[i : i + MANY]
            raw = (" " + " ".join(part)).encode("utf-8", "replace").replace(b" ", MARK)
            starts = np.flatnonzero(np.frombuffer(raw, np.uint8) == MARK[0])
            self.known.update(zip(part, self._segment(raw, np.diff(np.append(starts, len(raw))), self._side_by_side), strict=True))
        rest = new.difference(plain)
        spell = lambda u: (u if u[:1] == " " else " " + u).encode("utf-8", "replace").replace(b" ", MARK)
        spaced = [u for u in rest if len(u) <= WIDE]
        self.known.update(zip(spaced, self.units([spell(u) for u in spaced]), strict=True))
        long = {u: self._segment(raw := spell(u), np.array([len(raw)]), self._one_by_one)[0] for u in rest.difference(spaced)}
        get = self.known if not long else {**self.known, **long}
        return [b"".join(map(get.__getitem__, parts)) for parts in split]


def decode_ids(text: list[bytes], ids: list[int]) -> str:
    """Bytes of the pieces, markers as spaces without the first; bytes that are no UTF-8 become U+FFFD."""
    raw = b"".join(map(text.__getitem__, ids)).replace(MARK, b" ")
    return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ids (array<int>) of each row's whole text.

    A null text has null ids, an empty one none. Repeated rows stay; other
    columns are dropped; no rows give no rows.
    """
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(vocabulary)
        for b in text_slices(batches):
            got = own.encode(b.column("text").to_pylist())
            ends = np.cumsum([0, *(len(g) // 4 for g in got)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(got), "<i4"))
            ids = pa.ListArray.from_arrays(pa.array(ends), values, mask=b.column("text").is_null())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), ids], [*keep, "ids"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*keep).dtypes)
    return rows.mapInArrow(run, f"{kinds}, ids array<int>")


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """rows with decoded, the text of its column ids. Null ids give null; control pieces stand for nothing."""
    text = vocabulary.text
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                out = [None if ids is None else decode_ids(text, ids) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*names, "decoded"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "decoded string"]))


def op4_sentencepiece(spark, sf_dir):
    vocabulary = Vocabulary.load()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    rows = decode(encode(docs, vocabulary, ("doc_id", "h")), vocabulary)
    return rows.select("doc_id", "ids", F.size("ids").alias("n_pieces"), (F.xxhash64("decoded") == F.col("h")).alias("round_trip"))
