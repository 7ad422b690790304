"""Language identification of mixed-language text.

A word's script narrows the languages that it can be in; hashed character
n-grams score the word in each of them; Viterbi with a penalty for each switch
labels the words, and runs of one label are spans. A run of letters is several
words where its script changes and after every LONGEST letters, so all of a
text without spaces counts.

The model is learned from texts with a known language: n-gram counts and
script counts by language, added up inside tasks first and then by Spark. It
holds BUCKETS numbers for each language, whatever the size of the corpus; all
languages that occur are learned.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import lowered, stored, text_slices

UNDETERMINED = "und"
BUCKETS = 1 << 16
SWITCH, WORST = 12.0, 10.0
#: Share of a language's words in a script from which the language is a candidate there.
CANDIDATE = 0.002
#: Runs of letters that a worker remembers, characters that they may come from, letters of a word.
CACHE, HELD, LONGEST = 200_000, 64 << 20, 48
SLICE = 4 << 20

# First code points of letter ranges, each up to the next entry, and their scripts.
RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"),
    (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFE0, "other"), (0x20000, "han"), (0x30000, "other"),
)
SCRIPTS = sorted({s for _, s in RANGES})
_STARTS = np.array([a for a, _ in RANGES])
_INDEX = np.array([SCRIPTS.index(s) for _, s in RANGES])
_LETTER, _RUN = re.compile(r"[^\W\d_]"), re.compile(r"[^\W\d_]+")
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _letter_kinds() -> np.ndarray:
    """For each code point its script, -1 for signs that count as letters but have no script, -2 for what is no letter."""
    letters = _LETTER.findall("".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))))
    codes = np.array([ord(c) for c in letters])
    out = np.full(0x110000, -2, np.int8)
    out[codes] = np.where([c.isalpha() for c in letters], _INDEX[np.searchsorted(_STARTS, codes, "right") - 1], -1)
    return out


_KINDS = _letter_kinds()


def _word_pattern() -> re.Pattern:
    """Words: up to LONGEST letters of one script; signs that count as letters but have no script go with any."""

    def ranges(kind: int) -> str:
        at = np.flatnonzero((_KINDS == kind) | (_KINDS == -1))
        turns = np.flatnonzero(np.diff(at) > 1)
        return "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in zip(at[[0, *(turns + 1)]], at[[*turns, -1]], strict=True))

    order = sorted(range(len(SCRIPTS)), key=lambda i: SCRIPTS[i] != "latin")
    return re.compile("|".join(f"[{ranges(i)}]{{1,{LONGEST}}}" for i in order))


_WORD = _word_pattern()


def parts(runs: list[str]) -> list[list[str]]:
    """The words of each run of letters; most runs are one word."""
    return [[r] if len(r) <= LONGEST and r.isascii() else _WORD.findall(r) for r in runs]


def words_of(text: str) -> list[str]:
    return [w for p in parts(_RUN.findall(text)) for w in p]


def script_of(word: str) -> int:
    return int(scripts_of([word])[0])


def scripts_of(words: list[str]) -> np.ndarray:
    """Script of each word's first letter that has one; -1 without."""
    heads = np.frombuffer("".join([w[0] for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _KINDS[heads].astype(np.int64)
    for i in np.flatnonzero(out < 0):
        out[i] = next((k for c in words[i] if (k := _KINDS[ord(c)]) >= 0), -1)
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (a row for each position, a column for each kind; BUCKETS: none) and where each word starts.

    Kinds: letters, pairs, triples and fours with the word's ends, and the whole word.
    """
    codes = np.frombuffer((" " + " ".join(words) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - 2
    gap = codes == 32
    starts = np.flatnonzero(gap[:n])[: len(words)]
    out = np.full((n, 5), BUCKETS, np.int32)
    top = np.uint64(64 - 16)
    h = codes * _MIX[0]
    out[:, 0] = np.where(gap[:n], BUCKETS, (h[:n] * _MIX[3]) >> top)
    two = (h[:-1] ^ (codes[1:] * _MIX[1])) * _MIX[2]
    out[:, 1] = two[:n] >> top
    three = (two[:n] ^ (codes[2 : n + 2] * _MIX[3])) * _MIX[0]
    inner = gap[1 : n + 1]
    out[:, 2] = np.where(inner, BUCKETS, three >> top)
    four = (three[: n - 1] ^ (codes[3 : n + 2] * _MIX[1])) * _MIX[2]
    out[: n - 1, 3] = np.where(inner[: n - 1] | gap[2 : n + 1], BUCKETS, four >> top)
    place = np.arange(n, dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, n))).astype(np.uint64)
    whole = np.add.reduceat((h[:n] ^ (place * _MIX[1])) * _MIX[2], starts)
    out[starts, 4] = (whole * _MIX[3]) >> top
    return out, starts


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS + 1, languages): log probabilities, the last row 0
    candidates: np.ndarray  # (scripts, languages): bool
    usual: int  # the most frequent language

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each word in each language, 0 for the best and -WORST at least; and the state of the word: 1 known script, 0 other letters, -1 no letter."""
        k = len(self.languages)
        sums = np.zeros((len(words), k), np.float32)
        for i in range(0, len(words), 20_000):
            g, starts = grams(words[i : i + 20_000])
            rows = self.table[g[:, 0]]
            for j in range(1, 5):
                rows = rows + self.table[g[:, j]]
            sums[i : i + len(starts)] = np.add.reduceat(rows, starts)
        scripts = scripts_of(words)
        allowed = self.candidates[scripts] & (scripts >= 0)[:, None]
        known = allowed.any(1)
        sums[~allowed] = -np.inf
        sums[~known] = 0
        sums -= sums.max(1, keepdims=True)
        return np.maximum(sums, -WORST), np.where(scripts < 0, -1, known.astype(int))


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """language, bucket, count: sums over a task's texts. Buckets after BUCKETS count words by script."""
    runs: dict[str, Counter] = {}
    sums: dict[str, np.ndarray] = {}

    def add():
        for lang, counts in runs.items():
            to = sums.setdefault(lang, np.zeros(BUCKETS + 1 + len(SCRIPTS), np.int64))
            split = parts(list(counts))
            every = [w for p in split for w in p]
            weight = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), np.fromiter(map(len, split), np.int64, len(split)))
            for i in range(0, len(every), 20_000):
                g, starts = grams(every[i : i + 20_000])
                w = np.repeat(weight[i : i + 20_000], np.diff(np.append(starts, len(g))))
                for j in range(5):
                    to += np.bincount(g[:, j], w, len(to)).astype(np.int64)
            if every:
                scripts = scripts_of(every)
                to += np.bincount(np.where(scripts < 0, BUCKETS, BUCKETS + 1 + scripts), weight, len(to)).astype(np.int64)
        runs.clear()

    held = 0
    for b in text_slices(batches):
        held += b.nbytes
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            runs.setdefault(lang, Counter()).update(_RUN.findall(lowered(text)))
        if held > HELD or sum(map(len, runs.values())) > CACHE:
            add()
            held = 0
    add()
    for lang, to in sums.items():
        to[BUCKETS] = 0
        at = np.flatnonzero(to)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(to[at], pa.int64())], ["lang", "bucket", "n"])


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """Learns from text and lang where both are there and the row is not held out."""
    rows = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(_training, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = stored(sums)  # asked twice
    languages = sorted(r["lang"] for r in sums.where(F.col("bucket") > BUCKETS).select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool), -1)
    got = sums.where(F.col("lang").isin(languages)).toArrow()  # BUCKETS rows for each language at most
    counts = np.zeros((BUCKETS + 1 + len(SCRIPTS), len(languages)))
    counts[got["bucket"].to_numpy(), np.searchsorted(languages, got["lang"].to_numpy(zero_copy_only=False).astype(str))] = got["n"].to_numpy()
    seen, by_script = counts[:BUCKETS], counts[BUCKETS + 1 :]
    table = np.log((seen + 0.5) / (seen.sum(0) + 0.5 * BUCKETS))
    table = np.vstack([table - table.max(1, keepdims=True), np.zeros(len(languages))]).astype(np.float32)
    candidates = by_script >= np.maximum(CANDIDATE * by_script.sum(0), 1)
    return Model(languages, table, candidates, int(by_script.sum(0).argmax()))


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each row. scores: the rows of all texts one after another. All texts advance together, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    n, k = scores.shape
    v = np.zeros((len(sizes), k), np.float64)
    stay, jump = np.zeros((n, k), bool), np.zeros(n, np.int16)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts longer than t
    for t in range(longest):
        a, at = active[t], starts[: active[t]] + t
        w = v[:a]
        best = w.max(1, keepdims=True) - switch
        keep = w >= best
        stay[at], jump[at] = keep, w.argmax(1)
        v[:a] = np.where(keep, w, best) + scores[at]
    state, path = v.argmax(1) if len(v) else np.zeros(0, int), np.zeros(n, np.int16)
    for t in range(longest - 1, -1, -1):
        at = starts[: active[t]] + t
        s = state[: active[t]]
        path[at] = s
        state[: active[t]] = np.where(stay[at, s], s, jump[at])
    return path


class Labeller:
    """Spans and main language of texts."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        # Number of each run of letters; its words are `count` rows of scores and states, from row `first` on.
        self.ids: defaultdict[str, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.first, self.count, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.scores, self.states = np.zeros((0, len(model.languages)), np.float32), np.zeros(0, np.int8)

    def _look_up(self, new: list[str]):
        split = parts(new)
        count = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.append(self.first, len(self.states) + np.cumsum(count) - count)
        self.count = np.append(self.count, count)
        s, known = self.model.word_scores([w for p in split for w in p])
        self.scores, self.states = np.vstack([self.scores, s]), np.append(self.states, known.astype(np.int8))

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """language, score, spans (start, end, language) of each text."""
        return [(lang, score, spans) for lang, score, spans, _ in self.judge(texts)]

    def judge(self, texts: list[str | None], spans: bool = True) -> list[tuple[str, float, list[tuple[int, int, str]], float]]:
        """As label(), and the share of the text's words that is in its language."""
        if len(self.ids) > CACHE or self.held > HELD:
            self.__init__(self.model, self.switch)
        number, rows, old = self.ids.__getitem__, [], len(self.ids)
        for text in texts:
            found = _RUN.findall(lowered(text)) if text else []
            rows.append(np.fromiter(map(number, found), np.int32, len(found)))
        self.held += sum(len(t) for t in texts if t)
        if not self.model.languages:
            return [(UNDETERMINED, 0.0, [], 0.0)] * len(texts)
        if len(self.ids) > old:
            self._look_up(list(islice(self.ids, old, None)))
        runs = np.concatenate([*rows, np.zeros(0, np.int32)])
        run_text = np.repeat(np.arange(len(texts)), [len(r) for r in rows])
        count = self.count[runs]
        at, text_of = np.repeat(self.first[runs], count), np.repeat(run_text, count)
        at += np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        lengths = np.bincount(text_of, minlength=len(texts))
        simple = np.bincount(run_text, minlength=len(texts)) == lengths
        k, states = len(self.model.languages), self.states[at]
        whole = np.stack([np.bincount(text_of, self.scores[at, j], len(texts)) for j in range(k)], 1)
        path = np.repeat(whole.argmax(1), lengths).astype(np.int16)
        # One language throughout is best for sure if it loses less to the best label of each word than a switch costs.
        mixed = whole.max(1) < -self.switch
        if mixed.any():
            pick = mixed[text_of]
            path[pick] = viterbi(self.scores[at[pick]], lengths[mixed], self.switch)
        voting = states == 1
        votes = np.bincount(text_of[voting] * k + path[voting], minlength=len(texts) * k).reshape(-1, k)
        words = np.bincount(text_of[states >= 0], minlength=len(texts))
        ranked = np.sort(whole, 1)
        margin = ranked[:, -1] - ranked[:, -2] if k > 1 else np.full(len(texts), 30.0)
        ends = np.cumsum(lengths)
        path[states != 1] = -1
        out = []
        for i, text in enumerate(texts):
            if not words[i]:
                out.append((UNDETERMINED, 0.0, [], 0.0))
                continue
            if not votes[i].any():
                out.append((self.model.languages[self.model.usual], 0.0, [], 0.0))
                continue
            main = int(votes[i].argmax())
            covered = votes[i, main] / words[i]
            sure = covered / (1 + np.exp(-min(30.0, margin[i]))) if not mixed[i] else covered
            out.append((self.model.languages[main], float(sure), self._spans(text, path[ends[i] - lengths[i] : ends[i]], simple[i]) if spans else [], float(covered)))
        return out

    def _spans(self, text: str, path: np.ndarray, simple: bool) -> list[tuple[int, int, str]]:
        """Runs of one label, in characters; words of no known script belong to no span but do not end one. simple: each run of letters is one word."""
        known = np.flatnonzero(path >= 0)
        turns = known[np.flatnonzero(np.diff(path[known], prepend=-2))]
        name = lambda i: self.model.languages[path[i]]
        if len(turns) == 1 and path[0] >= 0 and path[-1] >= 0:
            end = len(text)
            while not _LETTER.match(text[end - 1]):
                end -= 1
            return [(_LETTER.search(text).start(), end, name(turns[0]))]
        if simple:
            letter = np.concatenate([[False], _KINDS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] > -2, [False]])
            edges = np.flatnonzero(letter[1:] != letter[:-1]).tolist()
            begins, ends = edges[::2], edges[1::2]
        else:
            begins, ends = zip(*(m.span() for m in _WORD.finditer(lowered(text))), strict=True)
        lasts = [known[np.searchsorted(known, t) - 1] for t in turns[1:]] + [known[-1]]
        return [(begins[a], ends[b], name(a)) for a, b in zip(turns, lasts, strict=True)]


def _label_batches(model: Model):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for b in text_slices(batches, limit=SLICE):
            got = labeller.label(b.column("text").to_pylist())
            spans = [[{"start": a, "end": z, "lang": x} for a, z, x in s] for *_, s in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return run


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, spans (start, end, lang) of each row's whole text.

    A null text, or one without a letter, is `und` with score 0 and no spans. A
    text whose scripts no learned language uses gets the most frequent language
    with score 0. Ties go to the first language in order of name. Repeated rows
    stay; other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_label_batches(model), "doc_id bigint, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def reject_unknown(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose main language is known and covers at least half of the words; all columns stay."""
    model = fit(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for b in text_slices(batches, limit=SLICE):
            got = labeller.judge(b.column("text").to_pylist(), spans=False)
            yield b.filter(pa.array([lang != UNDETERMINED and covered >= least for lang, _, _, covered in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(*names)


def op1_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = label(docs, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
