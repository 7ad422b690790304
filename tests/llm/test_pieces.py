import random

import numpy as np
import pytest

from stowage.llm.pieces import Segmenter, Vocabulary, decode, decode_ids, encode

NAMES = ["<unk>", "<s>"] + [f"<0x{i:02X}>" for i in range(256)]
PIECES = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "abab", "▁▁", "c", "é", "éa", "中文", "aba"]


@pytest.fixture(scope="module")
def small():
    rnd = random.Random(2)
    return Vocabulary.of(NAMES + PIECES, [0.0] * len(NAMES) + [-rnd.randrange(1, 60) / 4 for _ in PIECES], [True, True] + [False] * (256 + len(PIECES)), [False, False] + [True] * 256 + [False] * len(PIECES))


def best_sum(v, raw):
    """All pieces at all places, without the trie or units."""
    keys = {t: v.scores[i] for i, t in enumerate(v.text) if i >= len(NAMES)}
    text = raw.decode("latin-1")
    best = [0.0] + [-np.inf] * len(raw)
    for i in range(len(raw)):
        if raw[i] & 0xC0 == 0x80 and raw[i] != 0xFF:
            continue
        n = next(k for k in range(1, 5) if i + k == len(raw) or raw[i + k] & 0xC0 != 0x80) if raw[i] != 0xFF else 1
        options = {len(k): s for k, s in keys.items() if raw.startswith(k, i)}
        if n not in options:
            options[n] = v.fallback
        for k, s in options.items():
            best[i + k] = max(best[i + k], best[i] + s)
    assert text is not None
    return best[-1]


def value(v, ids):
    total, i = 0.0, 0
    while i < len(ids):
        if ids[i] >= len(NAMES):
            total, i = total + v.scores[ids[i]], i + 1
        else:
            first = v.text[ids[i]][0]
            total += v.fallback
            i += 1 if first < 0x80 or first == 0xFF else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
    return total


def test_best_sums_and_round_trips(small):
    rnd = random.Random(3)
    texts = ["", " ", "  ", "a", " a", "a ", "ab  ab", "▁a ▁", "é中文 ü", "ab" * 80, "zz\x00\n\t", "😀 a"]
    texts += ["".join(rnd.choice("aabbc  é中文z\n▁") for _ in range(rnd.randrange(1, 40))) for _ in range(300)]
    s = Segmenter(small)
    for _ in range(2):
        for text, got in zip(texts, s.encode(texts), strict=True):
            ids = np.frombuffer(got, "<i4").tolist()
            assert decode_ids(small.text, ids) == text
            raw = (" " + text if text else "").encode().replace(b" ", b"\xff")
            assert value(small, ids) == pytest.approx(best_sum(small, raw))


def test_vocabulary_must_split(small):
    with pytest.raises(ValueError):
        Vocabulary.of([*NAMES, "a▁b"], [0.0] * 259, [True, True] + [False] * 257, [False, False] + [True] * 256 + [False])


def test_public_vocabulary_and_frames(spark):
    v = Vocabulary.load()
    texts = [(1, "Hello world, a test.  Two spaces; ünïcode 中文 😀", 0), (2, None, 1), (3, "", 2), (3, "", 2), (None, " lead and trail ", 3), (5, "x" * 20000, 4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, ids int")
    out = decode(encode(docs, v), v).collect()
    assert len(out) == 6 and sorted(map(repr, (r["decoded"] for r in out))) == sorted(map(repr, (t[1] for t in texts)))
    assert encode(docs.where("false"), v).count() == 0
    assert next(r for r in out if r["doc_id"] == 2)["ids"] is None
