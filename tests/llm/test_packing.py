import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stowage.llm.packing import SIZE, Encoder, cuts, exact_fill, pack, patterns, slots


def test_encoder_equals_the_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a", "plain words, here.", "two  spaces", "tab\tand\n line", " lead", "trail ", "x\n y", "a \n b", "don't we'll 12 345 !!", "ñandú 日本語 テスト", "a<|endoftext|>b c", "<|endoftext|>", "nb sp  wide", "x\x1c y", "y" * 3000, "emoji 😀 ok"]
    rnd = random.Random(3)
    texts += ["".join(rnd.choice("ab é\n\t .,'19<|>中") for _ in range(60)) for _ in range(300)]
    e = Encoder()
    for _ in range(2):
        assert [np.frombuffer(b, e.kind).tolist() for b in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_words_of_letters_and_marks_are_encoded_by_runs():
    """Ids equal the library's on any mix; words of letters and marks never meet its pre-tokenizer, but for the marks between."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(9)
    pool = ["a", "the", "Zeta", "ñandú", "ƀȃ", "ß", ".", ",\n", "\n", "\n\n", "\t", "\r\n", "'s", "'", "'re", "-", "_", "__", "9", "½", "²", "中", "Ⅷ", "\u0301", "\x85", "\u00a0", "\x0b", "<|", "|>", "ж", "ª", "÷", "×", "~", "[", "`", " ", " ", "  "]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 12))) for _ in range(8000)]
    e = Encoder()
    for _ in range(2):
        assert [np.frombuffer(b, e.kind).tolist() for b in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    e, seen = Encoder(), []
    whole = e._whole
    e._whole = lambda text: (seen.append(text), whole(text))[1]
    text = "first " + " ".join(f"{a}{b}" for a in ("wordbla", "señor", "Öl") for b in ("", ",", ".\nNext", "\nend.", "!?)", "-to-be"))
    assert np.frombuffer(e.encode([text])[0], e.kind).tolist() == t.encode(text, add_special_tokens=False).ids
    assert set(seen) == {"first", ",", ".\n", "\n", ".", "!?)", "-"}


def test_new_words_meet_the_library_together():
    """Hundreds of new words are few calls, a run that begins many words is encoded once, and words met before are not encoded again."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(10)
    made = ["".join(rnd.choice(["re", "th", "Ou", "né", "Ġ", "ble"]) for _ in range(5)) for _ in range(900)]
    texts = ["start " + " ".join(w + mark for w in made for mark in ("", ",", ".\nNext")), "start", "start " + " ".join(made), "", "start  two", "start 12 don't 中文", "start tail ", "start <|endoftext|> x"]
    e, calls = Encoder(), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def tokenize(self, text):
            calls.append(text)
            return self.inner.tokenize(text)

    e.model = Counted(e.model)
    for _ in range(2):
        assert [np.frombuffer(b, e.kind).tolist() for b in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert calls == ["Next"]  # runs within words one by one, once; those that begin words as one text


def test_full_caches_change_no_ids(monkeypatch):
    monkeypatch.setattr("stowage.llm.packing.CACHE", 3)
    monkeypatch.setattr("stowage.llm.packing.AT_ONCE", 2)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(11)
    e = Encoder()
    for _ in range(20):
        texts = [" ".join(rnd.choice(["a", "ab", "über", "b.\nc", "x,", "12", "", "中", "z" * 70, "z" * 70 + "."]) for _ in range(rnd.randrange(9))) for _ in range(5)]
        assert [np.frombuffer(b, e.kind).tolist() for b in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        assert not any(len(w) > 64 for w in e.known)


def test_knapsack_and_patterns():
    lengths = np.array([7, 5, 3])
    best, last = exact_fill(np.array([7.0, 1.0, 1.0]), lengths, 16)
    assert best[15] == 3 and best[8] == 2 and best[1] == np.inf and best[16] == 4 and last[5] == 1
    rnd = random.Random(4)
    hist = {r: rnd.randrange(1, 40) for r in rnd.sample(range(1, 64), 40)}
    plan = patterns(hist, 64)
    used = {}
    for p, n in plan:
        assert sum(r * a for r, a in p.items()) == 64
        for r, a in p.items():
            used[r] = used.get(r, 0) + n * a
    assert all(used[r] <= hist[r] for r in used)
    paired = {r: 10 * (1 + min(r, 64 - r) % 7) for r in range(1, 64)}  # each length as often as its complement: all can be covered
    assert sum(64 * n for _, n in patterns(paired, 64, cover=1.0)) >= 0.98 * sum(r * n for r, n in paired.items())
    assert patterns({}, 64) == [] and patterns({5: 3}, 64) == []
    assert sum(hi - lo for _, lo, hi, _, _ in slots(plan)) == sum(used.values())


def test_cuts_tile_the_left_over_tokens():
    rnd = random.Random(5)
    for _ in range(50):
        sizes = [rnd.randrange(1, 1024) for _ in range(rnd.randrange(1, 9))]
        total, at, seen = sum(sizes), 0, {}
        for n in sizes:
            for s, o, m in cuts(at, n, total):
                assert seen.get(s, 0) == o
                seen[s] = o + m
            at += n
        assert sum(seen.values()) == total
        assert all(v == SIZE or v & (v - 1) == 0 for v in seen.values())


def test_pack_covers_every_id_once(spark):
    rnd = random.Random(6)
    rows = [(i % 50, " ".join(rnd.choice(["alpha", "beta", "gamma.", "Δelta"]) for _ in range(rnd.randrange(0, 900))), i) for i in range(60)]
    rows += [(100, None, 1), (101, "", 2), (None, "no id", 3), (102, "long " * 5000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset long")
    got = pack(docs).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [t.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows]
    assert got["length"].sum() == sum(map(len, ids))
    pads = 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        at = 0
        for o, n in zip(g.offset, g.length, strict=True):
            assert o == at
            at += n
        assert at <= SIZE
        pads += 0 if at & (at - 1) == 0 else SIZE - at
    assert pads == 0
    by_id = {r[0]: np.array(x, "<u4") for r, x in zip(rows, ids, strict=True) if r[0] is not None and r[0] >= 10 or r[0] is None}
    for i in range(10, 50):
        g = got[got.doc_id == i].sort_values("start")
        at = 0
        for s, n, c in zip(g.start, g.length, g.ids_crc32, strict=True):
            assert s == at and c == zlib.crc32(by_id[i][s : s + n])
            at += n
        assert at == len(by_id[i]) == g.doc_tokens.iloc[0]
    assert got.doc_id.isna().sum() == 1
    assert pack(docs.where("false")).count() == 0
