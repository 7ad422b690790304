"""Periodic runs of words, found while words are appended.

A block of L words that starts at a multiple of L and is complete gets a
catcher: it waits for the block to come again, d words later, for every d in
[L, 2L). Blocks have 8, 16, 32, ... words, and those of 8 also wait for d
below 8. A run of period d that is at least three periods and 24 words long
holds such a block and its copy, so some catcher sees it. Each appended word
ends one suffix of every block length, which is compared, by its hash, with
the blocks that wait for it: two at most for each length. A hit is a square,
or becomes one: it is extended word by word to the left, and to the right as
far as words have been appended; where it reaches the last word, it is taken
up again when more come. Squares of one period that touch merge into a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import table, text_slices

#: Words of the smallest block. A run has LEAST words and TIMES periods at least; LEAST holds two blocks, a period below BASE and one word less.
BASE, LEAST, TIMES = 8, 24, 3
#: Words that are appended at once; any number gives the same runs.
STRETCH = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two equally long neighbours from their hashes."""
    x = (a ^ (a >> np.uint64(29))) * _MIX + b
    return (x ^ (x >> np.uint64(32))) * _MIX


class RunCatcher:
    """Takes words as 64-bit numbers, by append(), and knows the runs of all words so far, by runs()."""

    def __init__(self) -> None:
        self.n = 0
        self.words = np.empty(64, np.int64)
        #: Of each block length: hashes of the stretches from position `begin` on; earlier ones wait for nothing.
        self.begin: list[int] = []
        self.hashes: list[np.ndarray] = []
        #: By period: [start, end] of each stretch with that period, in order of start.
        self.found: dict[int, list[list[int]]] = {}

    def append(self, more: np.ndarray) -> None:
        first, self.n = self.n, self.n + len(more)
        if self.n > len(self.words):
            self.words = np.concatenate([self.words[:first], np.empty(max(self.n, 2 * first) - first, np.int64)])
        self.words[first : self.n] = more
        for d, spans in self.found.items():  # open ones go on
            if spans[-1][1] == first:
                spans[-1][1] = self._right(first, d)
        size, level = BASE, 0
        while 2 * size <= self.n or size == BASE < self.n:
            if level == len(self.begin):
                self.begin.append(0)
                self.hashes.append(np.empty(0, np.uint64))
            self._advance(level, size)
            size, level = 2 * size, level + 1

    def _advance(self, level: int, size: int) -> None:
        """Compares the suffixes of this length that the appended words have completed."""
        begin, held = self.begin[level], self.hashes[level]
        done, last = begin + len(held), self.n - size + 1  # starts of stretches
        if last <= done:
            return
        if level:
            half, at = self.hashes[level - 1], self.begin[level - 1]
            new = _mixed(half[done - at : last - at], half[done - at + size // 2 : last - at + size // 2])
        else:
            part = self.words[done : last + size - 1].view(np.uint64)
            while size > 1:
                part, size = _mixed(part[: len(part) - (BASE // size)], part[BASE // size :]), size // 2
            new, size = part, BASE
        held = np.concatenate([held, new])
        at = np.arange(done, last)
        for back in (0, 1) if level == 0 else (1,):
            block = (at // size - back) * size
            waits = (block >= 0) & (block < at)
            hits = np.flatnonzero(waits)
            hits = hits[held[at[hits] - begin] == held[block[hits] - begin]]
            self._caught(block[hits], at[hits] - block[hits], size)
        # the next appended suffix starts at `last`: blocks before the one that waits for it have been waited out,
        # and the next length needs the stretches that its own next one is made of
        keep = max(begin, min(last // size * size - size, self._next(level + 1, size)))
        self.begin[level], self.hashes[level] = keep, held[keep - begin :]

    def _next(self, level: int, size: int) -> int:
        """The first start whose hash the length after `size` lacks."""
        return min(self.begin[level] + len(self.hashes[level]), max(0, self.n - 2 * size + 1)) if level < len(self.begin) else 0

    def _caught(self, block: np.ndarray, d: np.ndarray, size: int) -> None:
        """Extends the hits that lie in no known stretch of their period, or of a divisor of it."""
        known = [(p, *spans[-1]) for p, spans in self.found.items()] if len(block) else []
        while len(block):
            for p, s, e in known:
                new = (d % p != 0) | (block < s) | (block + d + size > e)
                block, d = block[new], d[new]
            if len(block):
                b, p, known = int(block[0]), int(d[0]), []
                if (self.words[b : b + size] == self.words[b + p : b + p + size]).all():
                    span = [self._left(b, p), self._right(b + p + size, p)]
                    self.found.setdefault(p, []).append(span)
                    known = [(p, *span)]
                block, d = block[1:], d[1:]

    def _right(self, end: int, d: int) -> int:
        """The end of the stretch of period d that reaches `end`."""
        step = 16
        while end < self.n:
            a, b = self.words[end : min(end + step, self.n)], self.words[end - d : min(end + step, self.n) - d]
            if (a != b).any():
                return end + int((a != b).argmax())
            end, step = end + len(a), min(2 * step, 1 << 20)
        return end

    def _left(self, start: int, d: int) -> int:
        """The start of the stretch of period d that begins at `start` or before."""
        step = 16
        while start:
            low = max(0, start - step)
            off = self.words[low:start] != self.words[low + d : start + d]
            if off.any():
                return start - int(off[::-1].argmax())
            start, step = low, min(2 * step, 1 << 20)
        return start

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of each run, by start, then period. The period is the smallest: a multiple of it has the same stretch."""
        least: dict[tuple[int, int], int] = {}
        for d, spans in self.found.items():
            for s, e in spans:
                if e - s >= max(LEAST, TIMES * d):
                    least[s, e] = min(d, least.get((s, e), d))
        return sorted((s, e - s, d) for (s, e), d in least.items())


def runs_of(words: list[bytes], stretch: int = STRETCH) -> list[tuple[int, int, int]]:
    """Runs of a list of words."""
    if len(words) < LEAST:
        return []
    catcher, numbers = RunCatcher(), np.fromiter(map(hash, words), np.int64, len(words))
    for i in range(0, len(words), stretch):
        catcher.append(numbers[i : i + stretch])
    return [r for r in catcher.runs() if words[r[0] : r[0] + r[1] - r[2]] == words[r[0] + r[2] : r[0] + r[1]]]


def _handle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in text_slices(batches):
        runs, best, collapsed = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            words = (text or b"").split()  # of bytes: at blanks, tab to carriage return, only
            found = runs_of(words)
            runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
            best.append(max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None))
            for s, n, p in found:
                words[s + p : s + n] = [None] * (n - p)
            collapsed.append(b" ".join(filter(None, words) if found else words))
        best = [None if b is None else dict(zip(("start", "length", "period"), b, strict=True)) for b in best]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(collapsed, pa.binary()).cast(pa.string(), safe=False)], ["id", "runs", "best", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row of docs: its id, runs (start, length, period), best (the run with the greatest length/period; ties: smallest start, then period) and the collapsed text.

    Words are what blanks (space, tab to carriage return) separate. A run is a
    stretch of words with smallest period q, at least 24 words and three
    periods long, that no neighbouring word extends. The collapsed text has
    the words, joined by one space, that no run repeats: a run's first q words
    stay unless another run repeats them. Null and empty texts have no words,
    no runs and an empty collapsed text; best is null without a run. Rows are
    independent, so ties, repeated rows and ids and null ids are rows like any
    other; nothing is shuffled. A task holds one slice of texts, or one longer
    text with about 100 bytes a word.
    """
    kind = dict(docs.dtypes)[id_column]
    span = "struct<start:bigint,length:bigint,period:bigint>"
    got = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(_handle, f"id {kind}, runs array<{span}>, best {span}, collapsed string")
    return got.withColumnRenamed("id", id_column)


def with_made_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts repeat from word a on what begins there, with the period p.

    h is the crc32 of the id as text and g = h div 10; texts with h mod 10 = 0
    and n > 0 words get a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(words)))
    rows = rows.withColumn("a", F.expr("if(size(w) > 0, (h div 10) % size(w), null)")).withColumn("p", F.expr("1 + (size(w) - a) div (3 + (h div 10) % 8)"))
    made = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    got = periodic_runs(with_made_runs(table(spark, sf_dir, "documents")))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return got.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), _digest(lines).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
