import random

import numpy as np

from stowage.llm.licenses import TEMPLATES, TEXTS, Scanner, align, op10_license_scans, scan, texts_in, words


def test_align_is_the_longest_common_run():
    rnd = random.Random(1)
    for _ in range(60):
        a, b = ([rnd.choice("xyz") for _ in range(rnd.randrange(1, 8))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if p == q else max(best[i][j + 1], best[i + 1][j])
        assert align(a, b, 0, 20)[0] == best[-1][-1]
    assert align(list("abc"), list("zzabc"), 2, 0) == (3, 2, 4)


def test_every_template_and_edits():
    s = Scanner(TEMPLATES)
    for name, text in TEMPLATES.items():
        whole = f"Some words before.\n{text}\nAnd words after it, again."
        got = s.scan(whole)
        assert [g[0] for g in got] == [name] and got[0][1] == 1.0
        assert words(whole[got[0][2] : got[0][3]]) == words(text)
    long = words(TEMPLATES["MIT-permission"])
    for i in range(0, len(long), 9):
        long[i] = "changed"
    assert [(g[0], g[1] > 0.8) for g in s.scan(" ".join(long))] == [("MIT-permission", True)]
    two = s.scan("Released under the MIT License. x Released under the MIT license")
    assert [g[0] for g in two] == ["MIT", "MIT"]
    assert s.scan("released under the weather") == s.scan(None) == s.scan("") == []


def test_whole_licenses_reworded():
    s = Scanner(TEMPLATES)
    bsd = TEMPLATES["BSD-3-Clause"].replace("copyright holder nor", "University of Somewhere nor").replace("COPYRIGHT HOLDERS AND", "REGENTS AND")
    mit = TEMPLATES["MIT-text"].replace("the Software is furnished", "it is furnished").replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM")
    gpl = "Foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2, or (at your option) any later version."
    for name, text in (("BSD-3-Clause", bsd), ("MIT-text", mit), ("GPL-2.0-or-later", gpl)):
        got = s.scan(f"Copyright 1999 Someone\n\n * {text}\n\nint main;")
        assert [g[0] for g in got] == [name] and 0.8 <= got[0][1] < 1
    half = words(TEMPLATES["BSD-2-Clause"])
    assert "BSD-2-Clause" not in [g[0] for g in s.scan(" ".join(half[: len(half) // 2]))]


def test_candidates_are_those_of_a_full_alignment():
    rnd = random.Random(4)
    s = Scanner(TEMPLATES, 0.8)
    for name, template in s.templates.items():
        tokens = list(template)
        for _ in range(len(tokens) // 20):
            tokens[rnd.randrange(len(tokens))] = "other"
        text = ["pad"] * rnd.randrange(9) + tokens + ["pad"] * rnd.randrange(9)
        n = align(template, text, 0, len(text) + len(template))[0]
        assert n >= 0.8 * len(template)
        assert (name, n / len(template)) in [g[:2] for g in s.scan(" ".join(text))]


def test_places_are_those_of_the_text():
    text = "\u0130\u0130 Released under the MIT License."
    ((name, _, start, end),) = Scanner(TEMPLATES).scan(text)
    assert name == "MIT" and text[start:end] == "Released under the MIT License"


def test_frame(spark):
    text = "w " * 30000 + "Licensed under CC BY-NC 4.0."
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "y"), (None, "Released under the MIT License.", "z"), (3, "plain", None)], "doc_id long, text string, license string")
    got = scan(docs)
    assert sorted(((r["doc_id"], r["license"]) for r in got.collect()), key=str) == [(1, "CC-BY-NC-4.0"), (1, "CC-BY-NC-4.0"), (None, "MIT")]
    assert scan(docs.where("false")).count() == 0


def test_many_notices_in_one_text_do_not_overlap():
    """Hundreds of notices, some inside longer ones: none overlap, in order, and none that stands alone is lost."""
    one = "Released under the MIT License. Some other words stand here between them. "
    got = Scanner(TEMPLATES).scan((one + TEMPLATES["MIT-permission"] + " and on it goes for a while. ") * 200)
    assert all(a[3] <= b[2] for a, b in zip(got, got[1:], strict=False))
    assert sum(g[0] == "MIT" for g in got) == sum(g[0] == "MIT-permission" for g in got) == 200


def _longest(a, b):
    """Length of the longest common subsequence, the whole table."""
    ids = {w: i for i, w in enumerate({*a, *b})}
    b, row = np.array([ids[w] for w in b]), np.zeros(len(b) + 1, int)
    for w in a:
        row[1:] = np.maximum.accumulate(np.where(b == ids[w], row[:-1] + 1, row[1:]))
    return int(row.max())


def test_whole_query_equals_full_alignment(spark, tmp_path):
    """Damaged and cut templates, the long ones of a folder among them: each is found as what a full alignment with all templates finds."""
    templates, rnd = {n: words(t) for n, t in (TEMPLATES | texts_in(TEXTS)).items()}, random.Random(8)
    texts = []
    for name, template in templates.items():
        tokens = list(template)
        for _ in range(len(tokens) // 25):
            tokens[rnd.randrange(len(tokens))] = "other"
        tokens = tokens[: len(tokens) - len(tokens) // 9] if len(tokens) > 40 and len(texts) % 2 else tokens
        texts.append("\n".join(["pad"] * rnd.randrange(9) + tokens + ["pad"] * (rnd.randrange(9) if len(texts) % 3 else 0)))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op10_license_scans(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        tokens = words(text)
        each = {n: _longest(t, tokens) for n, t in templates.items() if len(tokens) >= 0.8 * len(t)}
        n, _, name = min((-n, -n / len(templates[name]), name) for name, n in each.items() if n >= 0.8 * len(templates[name]))
        assert (got[i]["license"], got[i]["coverage"]) == (name, -n / len(templates[name]))
        inside = words(text[got[i]["start"] : got[i]["end"]])
        assert _longest(templates[name], inside) == -n and inside[0] in templates[name] and inside[-1] in templates[name]


def test_a_text_that_ends_before_its_template_and_folders(tmp_path):
    long = words(TEMPLATES["BSD-3-Clause"])
    ((name, share, *_),) = Scanner({"long": " ".join(long)}).scan(" ".join(long[: len(long) * 85 // 100]))
    assert name == "long" and 0.8 <= share < 0.86
    (tmp_path / "A").write_bytes(b"first words of a text \xff")
    (tmp_path / "B").symlink_to(tmp_path / "A")
    (tmp_path / "C").mkdir()
    assert list(texts_in(str(tmp_path))) == ["A-text"] and texts_in(str(tmp_path / "none")) == {}
    assert Scanner({"empty": "", "one": "word"}).scan("word word word word") == []


def test_equally_good_matches_are_the_first_name(spark):
    docs = spark.createDataFrame([(1, "x a b c d e x"), (1, "x a b c d e x")], "doc_id long, text string")
    got = scan(docs, {"second": "a b c d e", "first": "a b c d e"}).collect()
    assert [(r["license"], r["coverage"], r["start"], r["end"]) for r in got] == [("first", 1.0, 2, 11)] * 2
