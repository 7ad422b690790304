"""Packing documents into fixed-length token sequences by cutting-stock column generation.

Whole blocks of a document fill sequences by themselves. What is left of each
document (0 to SIZE-1 tokens) is an item of the cutting-stock problem: a
linear program over patterns, each of which fills a sequence exactly, covers as
many items as possible uncut. Its input is the histogram of item lengths, at
most SIZE numbers whatever the number of documents. Columns are priced by
knapsack dynamic programming with the program's duals, and the rounded
patterns are given to the documents ranked within each length. Items that no
pattern takes are laid end to end and cut at sequence ends; the last, partly
filled sequence is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import stored, text_slices

SIZE = 1024
#: Different words whose ids a worker remembers (some 150 bytes each; as many runs that begin none), and their greatest length.
CACHE, LONGEST = 200_000, 64
#: Words that the library encodes as one text.
AT_ONCE = 8192
#: Bytes of text whose different words are found together.
SLICE = 4 << 20
#: A left-over table of at most so many rows is broadcast (24 bytes a row).
SMALL = 200_000
#: Letters of Latin scripts; other ASCII characters that the pre-tokenizer never joins to a letter after them (no apostrophe), and blanks.
LETTER, MARK, BLANK = "[A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f]", r"[!-&(-/:-@\[-`{-~]", r"[\t\n\r]"
#: Words of which each run of letters and each run between is encoded by itself: a run before letters ends in one blank at most, a last one in none.
_BETWEEN, _LAST = rf"(?:(?:{MARK}|{BLANK})*{MARK}{BLANK}?|{BLANK})", rf"(?:{MARK}|{BLANK})*{MARK}"
_LETTERS, _SHAPE, _CUT = re.compile(f"{LETTER}+").fullmatch, re.compile(f"{LETTER}+(?:{_BETWEEN}{LETTER}+)*(?:{_LAST})?").fullmatch, re.compile(f"{LETTER}+|(?:{MARK}|{BLANK})+").findall

_ID = attrgetter("id")


def _printed() -> dict[int, str]:
    """Byte-level vocabularies' character for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


@lru_cache(maxsize=2)
def _encoder(path: str | None) -> Encoder:
    """One for each worker process, so that its words serve all of the worker's tasks."""
    return Encoder(path)


class Encoder:
    """Ids of whole texts, as bytes of `kind`, equal to those of the tokenizer file.

    The vocabulary's pre-tokenizer always starts a new word at a single space
    between two other characters, so the words between such spaces are encoded
    once each: many at a time, as one text, in whose ids each word begins at a
    token that begins with a space. Words of letters and marks are cut into
    runs as the pre-tokenizer cuts them, and the runs of letters are given to the
    library's model, those that begin words as one text cut at NUL. A text with
    other spacing, or with the text of a special token, is encoded whole.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share out the cores
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        n = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marked = re.compile("|".join(map(re.escape, self.special)) or "(?!)").search
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(n)])
        self.model, self.printed = self.tokenizer.model, _printed()
        self.codes = np.array([0, *(ord(self.printed[b]) for b in range(1, 256))], "<u4")  # NUL stays
        self.at_nul = Tokenizer(self.model)
        self.at_nul.pre_tokenizer = CharDelimiterSplit("\0")
        kind = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.runs = self.tokenizer.normalizer is None and kind.get("type") == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"] and not any(map(_LETTERS, self.special))
        self.known: dict[str, bytes] = {}
        self.between: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        (got,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)  # without offsets
        return np.array(got.ids, self.kind).tobytes()

    def _parts(self, raw: bytes, n: int) -> list[bytes] | None:
        """Ids of n words, each of which begins at a token that begins with a space; None if these are not n."""
        starts = np.flatnonzero(self.spaced[np.frombuffer(raw, self.kind)])
        if len(starts) != n:
            return None
        at = (starts * self.kind.itemsize).tolist()
        return [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)], strict=True)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space before each; many as one text."""
        return self._parts(self._whole(" " + " ".join(words)), len(words)) or [self._whole(" " + w) for w in words]

    def _first_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of letters with a space before each, by the model alone; many as one text."""
        text = self.codes[np.frombuffer((" " + "\0 ".join(runs)).encode(), np.uint8)].tobytes().decode("utf-32-le")
        (got,) = self.at_nul.encode_batch_fast([text], add_special_tokens=False)
        return self._parts(np.array(got.ids, self.kind).tobytes(), len(runs)) or [self._run(r, "\u0120") for r in runs]

    def _run(self, letters: str, space: str) -> bytes:
        """Ids of one run of letters; space: the vocabulary's character for a space before it, or none."""
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.printed)
        return array(self.kind.char, map(_ID, self.model.tokenize(space + letters))).tobytes()

    def _by_runs(self, runs: list[str]) -> bytes:
        """Ids of a word of the shape, cut into runs, with a space before it; the first run is a known word."""
        out = [self.known[runs[0]]]
        for i, run in enumerate(runs[1:]):
            held = self.heads if i % 2 else self.between
            if (ids := held.get(run)) is None:
                ids = self._run(run, "") if i % 2 else self._whole(run)
                if len(run) <= LONGEST and len(held) < CACHE:
                    held[run] = ids
            out.append(ids)
        return b"".join(out)

    def _learn(self, new: list[str]) -> list[str]:
        """Adds words to the known ones, and those that begin them, which are returned. Words with blanks at an end or special tokens are left to whole texts."""
        known, begin = self.known, []
        if self.runs:
            shaped = [w for w in new if _SHAPE(w)]
            letters = [w for w in shaped if w.isalpha()]
            mixed = [(w, _CUT(w)) for w in shaped if not w.isalpha() and not self.marked(w)]
            begin = list({runs[0] for _, runs in mixed}.difference(known, letters))
            letters += begin
            for i in range(0, len(letters), AT_ONCE):
                part = letters[i : i + AT_ONCE]
                known.update(zip(part, self._first_runs(part), strict=True))
            known.update([(w, self._by_runs(runs)) for w, runs in mixed])
            new = [w for w in new if w not in known]
        plain = [w for w in new if w and not w[0].isspace() and not w[-1].isspace() and not self.marked(w)]
        for i in range(0, len(plain), AT_ONCE):
            part = plain[i : i + AT_ONCE]
            known.update(zip(part, self._words(part), strict=True))
        return begin

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text. Arrow splits the texts, finds their different words and lays the words' ids end to end."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        split = pc.split_pattern(texts, " ")
        words = split.values.dictionary_encode()
        different, known, heads = words.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known, self.heads
        found = list(map(known.get, different))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = [different[i] for i in missing]
        collects = gc.isenabled()
        gc.disable()  # a pass for every so many tokens finds nothing
        try:
            new += self._learn(new)
        finally:
            if collects:
                gc.enable()
        for i in missing:
            found[i] = known.get(different[i])  # none: texts with this word are encoded whole
        ids = pa.array(found, pa.large_binary())
        at, first = words.indices.to_numpy(), split.offsets.to_numpy()
        strange = np.append(0, np.cumsum(np.asarray(ids.is_null())[at]))[first]
        ends = ids.take(words.indices)
        raw, ends = memoryview(ends.buffers()[2] or b""), np.frombuffer(ends.buffers()[1], np.int64, len(at) + 1)
        out = []
        for i, (odd, word, start, stop) in enumerate(zip(np.diff(strange).tolist(), at[first[:-1]].tolist(), ends[first[:-1] + 1].tolist(), ends[first[1:]].tolist(), strict=True)):
            if odd:
                out.append(self._whole(texts[i].as_py()))
                continue
            if (head := heads.get(w := different[word])) is None:
                head = self._whole(w)
                if len(w) <= LONGEST and len(heads) < CACHE:
                    heads[w] = head
            out.append(head + raw[start:stop])
        # Full: what was there first, so mostly the frequent words, stays.
        full = len(known) > CACHE
        for w in new:
            if full or len(w) > LONGEST:
                known.pop(w, None)
        return out


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, doc_tokens, crcs of the whole blocks, and the ids of the rest with their crc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in text_slices(batches, limit=SLICE):
            rows = []
            for ids in encoder.encode(pc.fill_null(b.column("text"), "")):
                ids = np.append(np.frombuffer(ids, encoder.kind), encoder.kind.type(0))
                n = len(ids) // SIZE * SIZE
                wide = ids.astype("<u4")
                rows.append((len(ids), [zlib.crc32(wide[i : i + SIZE]) for i in range(0, n, SIZE)], zlib.crc32(wide[n:]), ids[n:].tobytes()))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "doc_tokens", "crcs", "crc", "rest"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, doc_tokens bigint, crcs array<bigint>, crc bigint, rest binary")


def exact_fill(costs: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack table: the least cost of filling 0..size exactly, and the item taken last. lengths descend."""
    best, last = np.full(size + 1, np.inf), np.full(size + 1, -1)
    best[0] = 0
    first = np.searchsorted(-lengths, -np.arange(size + 1))  # items from here on fit
    for c in range(1, size + 1):
        if (k := first[c]) < len(lengths):
            v = best[c - lengths[k:]] + costs[k:]
            if v[i := int(v.argmin())] < np.inf:
                best[c], last[c] = v[i], k + i
    return best, last


def patterns(histogram: dict[int, int], size: int = SIZE, cover: float = 0.998, pivots: int = 6000) -> list[tuple[dict[int, int], int]]:
    """Rounded patterns {length: copies}, times used; none uses more items than there are.

    Maximises the number of exactly filled sequences under the item counts by
    the revised simplex method from the slack basis; stops at the optimum, or
    once `cover` of all tokens is covered.
    """
    lengths = np.array(sorted((r for r, n in histogram.items() if n > 0), reverse=True), int)
    if not len(lengths):
        return []
    m, count = len(lengths), np.array([histogram[r] for r in lengths], float)
    most = float(lengths @ count) / size
    x = count + np.random.default_rng(0).uniform(0, 1e-5, m)  # against degenerate steps
    inverse, y = np.eye(m), np.zeros(m)
    basis: list[dict[int, int] | None] = [None] * m  # None: slack

    def enter(items: dict[int, int], value: float) -> bool:
        nonlocal y
        at = np.fromiter(items, int)
        gain = value - float(y[at] @ np.fromiter(items.values(), float))
        if gain < 1e-9:
            return False
        d = inverse[:, at] @ np.fromiter(items.values(), float)
        ratio = np.full(m, np.inf)
        np.divide(x, d, out=ratio, where=d > 1e-9)
        if not np.isfinite(ratio[row := int(ratio.argmin())]):
            return False
        step, pivot = ratio[row], inverse[row] / d[row]
        x[:] = np.maximum(x - step * d, 0)
        x[row] = step
        inverse[:] -= np.outer(d, pivot)
        inverse[row] = pivot
        y = y + gain * pivot
        basis[row] = items if value else None
        return True

    used = 0
    while used < pivots:
        covered = sum(v for v, b in zip(x, basis, strict=True) if b)
        if covered >= cover * most:
            break
        moved = 0
        for j in np.flatnonzero(y < -1e-9)[:16]:
            moved += enter({int(j): 1}, 0.0)
        best, last = exact_fill(np.maximum(y, 0), lengths, size)
        with_item = np.maximum(y, 0) + best[size - lengths]
        for j in np.argsort(with_item, kind="stable")[:32]:
            if with_item[j] > 1 - 1e-9:
                break
            items, c = {int(j): 1}, size - int(lengths[j])
            while c:
                items[int(last[c])] = items.get(int(last[c]), 0) + 1
                c -= int(lengths[last[c]])
            moved += enter(items, 1.0)
        if not moved:
            break
        used += moved
    left, out = count.astype(int), []
    chosen = sorted(((float(v), b) for v, b in zip(x, basis, strict=True) if b), key=lambda p: -(p[0] % 1))
    whole = []
    for v, b in chosen:
        n = min([int(v + 1e-3), *(left[j] // a for j, a in b.items())])
        for j, a in b.items():
            left[j] -= n * a
        whole.append(n)
    for (_, b), n in zip(chosen, whole, strict=True):
        if all(left[j] >= a for j, a in b.items()):
            for j, a in b.items():
                left[j] -= a
            n += 1
        if n:
            out.append(({int(lengths[j]): a for j, a in b.items()}, n))
    return out


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """length, first rank, rank after the last, sequence of the first rank, offset. At most a row for each item of each pattern."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in plan:
        at = 0
        for r, copies in sorted(pattern.items(), reverse=True):
            for _ in range(copies):
                start = taken.get(r, 0)
                out.append((r, start, start + n, sequence, at))
                taken[r], at = start + n, at + r
        sequence += n
    return out


def cuts(start: int, length: int, total: int, size: int = SIZE) -> list[tuple[int, int, int]]:
    """Pieces of the stretch start..start+length of left-over tokens: sequence number, offset there, length."""
    full, out, end = total // size * size, [], start + length
    while start < end:
        if start < full:
            sequence, first, last = start // size, start // size * size, (start // size + 1) * size
        else:  # the tail is cut into descending powers of two
            sequence, first, rest = full // size, full, total - full
            while start >= (last := first + (1 << (rest.bit_length() - 1))):
                sequence, first, rest = sequence + 1, last, rest - (last - first)
        stop = min(end, last)
        out.append((sequence, start - first, stop - start))
        start = stop
    return out


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is packed as an empty one: its closing id alone. Repeated rows,
    and rows with a null doc_id, are packed each for itself. Other columns are
    ignored. No rows give no rows. Ranks and running sums are taken within
    hashed buckets, whose totals are added up afterwards, so neither a frequent
    length nor a frequent id lands in one task.
    """
    spark = docs.sparkSession
    rows = stored(tokenised(docs, path).withColumn("uid", F.monotonically_increasing_id()))
    histogram = {r["r"]: r["n"] for r in rows.groupBy((F.col("doc_tokens") % SIZE).alias("r")).agg(F.count("*").alias("n")).collect()}
    buckets = max(256, min(1 << 16, sum(histogram.values()) // 200_000))
    plan = slots(patterns({r: n for r, n in histogram.items() if r}))
    filled = max((s[3] + s[2] - s[1] for s in plan), default=0)

    items = rows.select("uid", "doc_id", "doc_tokens", "crcs", "crc", (F.col("doc_tokens") % SIZE).alias("r"), F.size("crcs").cast("bigint").alias("blocks"), F.pmod(F.xxhash64("uid"), F.lit(buckets)).alias("s"))
    within, each = Window.partitionBy("s").orderBy("uid"), Window.partitionBy("s", "r").orderBy("uid")
    before = lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c)
    items = items.withColumn("block0", before("blocks", within)).withColumn("rank", F.row_number().over(each).cast("bigint") - 1)
    sized = rows.select((F.col("doc_tokens") % SIZE).alias("r"), F.size("crcs").cast("bigint").alias("blocks"), F.pmod(F.xxhash64("uid"), F.lit(buckets)).alias("s"))
    ranks = sized.groupBy("s", "r").agg(F.count("*").alias("n")).withColumn("rank0", before("n", Window.partitionBy("r").orderBy("s"))).select("s", "r", "rank0")
    totals = sized.groupBy("s").agg(F.sum("blocks").alias("n")).withColumn("blocks0", before("n", Window.orderBy("s"))).select("s", "blocks0")
    items = items.join(ranks, ["s", "r"]).join(F.broadcast(totals), "s")  # totals: a row for each bucket, 65,536 at most
    places = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "r long, lo long, hi long, seq0 long, offset long")
    at = F.col("rank0") + F.col("rank")
    items = items.withColumn("at", at).join(F.broadcast(places).withColumnRenamed("r", "pr"), (F.col("r") == F.col("pr")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")), "left")
    items = stored(items.select("uid", "doc_id", "doc_tokens", "crcs", "crc", "r", "s", (F.col("blocks0") + F.col("block0")).alias("block0"), (F.col("seq0") + F.col("at") - F.col("lo")).alias("seq"), "offset"))

    loose = items.where("r > 0 and seq is null").select("uid", "doc_id", "doc_tokens", "r", "s")
    sums = {r["s"]: r["n"] for r in loose.groupBy("s").agg(F.sum("r").alias("n")).collect()}  # a row for each bucket
    total = sum(sums.values())
    starts, at0 = [], 0
    for s in sorted(sums):
        starts.append((s, at0))
        at0 += sums[s]
    loose = loose.withColumn("at", before("r", within)).join(F.broadcast(spark.createDataFrame(starts or [(0, 0)], "s long, at0 long")), "s")
    loose = loose.select("uid", "doc_id", "doc_tokens", "r", (F.col("at0") + F.col("at")).alias("at"))
    if loose.count() <= SMALL:
        loose = F.broadcast(loose)
    tail = len(cuts(total // SIZE * SIZE, total % SIZE, total))
    first_block = filled + total // SIZE + tail

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _encoder(path).kind
        for b in batches:
            out = []
            for doc_id, tokens, r, start, rest in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "r", "at", "rest")), strict=True):
                ids, done = np.frombuffer(rest, kind).astype("<u4"), 0
                for sequence, offset, n in cuts(start, r, total):
                    out.append((doc_id, tokens - r + done, n, zlib.crc32(ids[done : done + n]), tokens, filled + sequence, offset))
                    done += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], NAMES)

    pieces = rows.select("uid", "rest").join(loose, "uid").mapInArrow(cut, ", ".join(f"{c} bigint" for c in NAMES))
    blocks = items.select("doc_id", "doc_tokens", "block0", F.posexplode("crcs").alias("i", "ids_crc32"))
    blocks = blocks.select("doc_id", (F.col("i") * F.lit(SIZE).cast("bigint")).alias("start"), F.lit(SIZE).cast("bigint").alias("length"), "ids_crc32", "doc_tokens", (F.col("block0") + F.col("i") + first_block).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    fitted = items.where("r > 0 and seq is not null").select("doc_id", (F.col("doc_tokens") - F.col("r")).alias("start"), F.col("r").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", F.col("seq").alias("sequence_id"), "offset")
    return blocks.select(*NAMES).union(fitted.select(*NAMES)).union(pieces.select(*NAMES))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op8_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
