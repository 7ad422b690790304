import itertools
import random

import numpy as np

from stowage.llm.language import SCRIPTS, Labeller, fit, grams, label, reject_unknown, script_of, viterbi

EN = "the quick brown fox jumps over the lazy dog and then some more words of this story are here with that thing".split()
DE = "der schnelle braune fuchs springt über den faulen hund und dann noch einige wörter dieser geschichte sind hier".split()
RU = "быстрая коричневая лиса прыгает через ленивую собаку и потом ещё слова этой истории".split()


def corpus(spark, extra=()):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices((EN, DE, RU)[i % 3], k=30)), ("en", "de", "ru")[i % 3]) for i in range(120)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")


def test_viterbi_is_optimal():
    rnd = np.random.default_rng(0)
    lengths = np.array([3, 1, 0, 5, 4])
    scores = -rnd.integers(0, 9, (int(lengths.sum()), 3)).astype(float)
    path, at = viterbi(scores, lengths, 3.0), 0
    value = lambda s, p: sum(s[i, x] for i, x in enumerate(p)) - 3.0 * sum(a != b for a, b in itertools.pairwise(p))
    for n in lengths:
        part = scores[at : at + n]
        if n:
            assert value(part, path[at : at + n]) == max(value(part, p) for p in itertools.product(range(3), repeat=int(n)))
        at += n


def test_scripts_and_grams():
    assert [SCRIPTS[script_of(w)] for w in ("word", "слово", "λέξη", "言葉", "ことば", "단어", "كلمة")] == ["latin", "cyrillic", "greek", "han", "kana", "hangul", "arabic"]
    assert script_of("²") == -1
    (a, s1), (b, s2) = grams(["abc", "x"]), grams(["abc"])
    assert s1.tolist() == [0, 4] and (a[:4] == b[:4]).all() and s2.tolist() == [0]


def test_labels_spans_and_edges(spark):
    docs = corpus(spark)
    model = fit(docs)
    assert model.languages == ["de", "en", "ru"]
    mixed = " ".join(EN[:12]) + " " + " ".join(DE[:12]) + " " + " ".join(RU[:5]) + "."
    (lang, score, spans), *rest = Labeller(model).label([mixed, None, "", "123 -- !", "日本語", " ".join(DE * 3000)])
    assert lang in ("en", "de") and 0 < score < 1
    assert [s[2] for s in spans] == ["en", "de", "ru"]
    assert mixed[spans[1][0] : spans[1][1]] == " ".join(DE[:12]) and mixed[spans[2][0] : spans[2][1]] == " ".join(RU[:5])
    assert rest[:3] == [("und", 0.0, [])] * 3
    assert rest[3] == (model.languages[model.usual], 0.0, [])
    assert rest[4][0] == "de" and len(rest[4][2]) == 1
    again = Labeller(model).label([mixed])[0]
    assert again == (lang, score, spans)


def test_frames(spark):
    docs = corpus(spark, [(200, None, "en"), (200, None, "en"), (None, "the lazy dog", None), (201, "...", None)])
    model = fit(docs)
    got = label(docs.selectExpr("doc_id", "text", "lang as score", "lang as lang_pred"), model)
    assert got.columns == ["doc_id", "lang_pred", "score", "spans"] and got.count() == 124
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    kept = reject_unknown(docs)
    assert kept.columns == docs.columns and kept.count() == 121
    none = docs.where("false")
    assert fit(none).languages == [] and label(docs, fit(none)).where("lang_pred <> 'und'").count() == 0
    assert label(none, model).count() == 0


def test_all_of_a_run_without_spaces_counts(spark):
    docs = corpus(spark)
    labeller = Labeller(fit(docs))
    joined = "".join(RU) + "".join(EN * 4)
    (lang, _, spans), (late, _, _) = labeller.label([joined, "".join(EN[:12]) + "".join(DE * 12)])
    assert lang == "en" and [s[2] for s in spans] == ["ru", "en"]
    assert joined[spans[0][0] : spans[0][1]] == "".join(RU) and spans[1][1] == len(joined)
    assert late == "de"


def test_every_language_is_learned(spark):
    rows = [(4 * i + j, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} common", f"l{i:03}") for i in range(203) for j in range(4)]
    assert len(fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages) >= 201


def test_close_languages_do_not_hide_coverage(spark):
    """Three of four words are of the language, but two languages score nearly alike: the document stays."""
    rows = [(i, "aba abo abi abu", lang) for i in range(40) for lang in ("xa", "xb")]
    docs = spark.createDataFrame([*rows, (100, "aba abo abi \u8a00", None)], "doc_id long, text string, lang string")
    ((lang, score, spans, covered),) = Labeller(fit(docs)).judge(["aba abo abi \u8a00"])
    assert covered == 0.75 and score < 0.5
    assert reject_unknown(docs).where("doc_id = 100").count() == 1
