import random

import corpus_pipeline
from stowage.llm.language import Labeller
from stowage.llm.language import fit as fit_language
from stowage.llm.simhash import fingerprint
from stowage.llm.toxicity import Scorer
from stowage.llm.toxicity import fit as fit_toxicity

SYLLABLES = "ba ke li mo nu ra se ti vo za ching ther ond ist".split()


def rows():
    rnd = random.Random(8)
    out = []
    for i in range(240):
        words = ["".join(rnd.choices(SYLLABLES, k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(5, 60))]
        if i % 8 == 0:
            words.insert(rnd.randrange(len(words)), "grumbixor")
        out.append((i, " ".join(words), "en", f"s{i % 3}", 0))
    out += [(300 + i, out[1][1], "en", "s0", 0) for i in range(20)]
    return [*out, (400, None, None, None, None), (401, "12 34 --", "en", "s", 1), (402, "", "en", "s", 0)]


def test_run_equals_plain_python(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    lexicon, (w0, w1, w2) = fit_toxicity(docs, labels)
    scorer = Scorer(lexicon)
    kept = []
    for r in rows():
        best, total = scorer.features(r[1])
        if w0 + w1 * best + w2 * total < 0:
            kept.append(r)
    assert {r[0] for r in kept} == {r[0] for r in rows() if not (r[0] < 240 and r[0] % 8 == 0)}
    labeller = Labeller(fit_language(spark.createDataFrame(kept, docs.schema)))
    kept = [r for r, (lang, score, _) in zip(kept, labeller.label([r[1] for r in kept]), strict=True) if lang != "und" and score >= 0.5]
    assert not {400, 401, 402} & {r[0] for r in kept}
    prints = {r[0]: fingerprint(r[1]) for r in kept}
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert set(got.doc_id) == {i for i in root if root[i] == i}
    assert got.groupby("doc_id").length.sum().eq(got.groupby("doc_id").doc_tokens.first()).all()


def test_stages_keep_columns():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "packing"]
