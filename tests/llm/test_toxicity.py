from stowage.llm.toxicity import Scorer, fit, grammar, reject_toxic, score


def test_grammar_weights_clauses():
    s = Scorer({"idiot": 5.0, "lowei*": 4.0})
    weight = lambda t: s.features(t)[0]
    assert weight("you idiot") > weight("an idiot") > weight("he said: fine. she said an idiot") > 0
    assert weight("not an idiot") < weight("an idiot")
    assert weight("Loweixyz ist da") == 4.0
    assert weight("kill time") == 0 and weight("i kill you") > 0 and weight("you i kill") > 0
    assert s.clauses("fine words, you idiot! end") == [(12, 21, 6.5)]
    assert s.clauses(None) == [] and s.features("") == (0.0, 0.0)
    assert len(grammar().states()) == 3 * 4 * 2


def test_learns_and_rejects(spark):
    rows = [(i, f"plain words number {i} about a thing and w{i % 7} grumbix{i}" if i % 3 == 0 else f"plain words number {i} about a thing and w{i % 7}") for i in range(600)]
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows] + [(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)] + [(None, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    got = {r["doc_id"]: r for r in score(docs, model).collect()}
    assert len(got) == 601 and got[None]["predicted"] == 0
    assert all(got[i]["predicted"] == int(i % 3 == 0) and 0 <= got[i]["score"] <= 1 for i in range(600))
    left = reject_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == 401


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (1, "you idiot"), (2, "fine"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in score(docs, fit(docs, labels)).orderBy("doc_id").collect()] == [1, 1, 0, 0]
    assert score(docs.where("false"), fit(docs.where("false"), labels)).count() == 0


def test_equal_tables_give_equal_models_and_places_are_those_of_the_text(spark):
    rows = [(i, f"some shared words of a text here {'grumbix' if i % 3 == 0 else 'fine'} number {i % 40}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    assert fit(docs, labels) == fit(docs.repartition(7), labels.repartition(3))
    text = "\u0130\u0130 fine, you idiot! " + "x" * 60
    ((start, end, _),) = Scorer({"idiot": 5.0}).clauses(text)
    assert text[start:end] == "you idiot"


def test_scores_equal_enumerated_grammar():
    """Each clause by plain rules: state of target, words since a negator, a reporter before."""
    import itertools

    from stowage.llm.toxicity import NEGATORS, REPORTERS, TARGETS, THREATS

    scorer = Scorer({"idiot": 5.0})
    for words in itertools.product(("you", "idiot", "kill", "not", "said", "plain"), repeat=4):
        total, place, negated, reported = 0.0, "none", 0, False
        for w in words:
            factor = (0.4 if negated else 1.0) * (0.6 if reported else 1.0)
            negated = 3 if w in NEGATORS else max(negated - 1, 0)
            factor = factor / 0.4 if w in NEGATORS and factor in (0.4, 0.4 * 0.6) else factor
            reported = reported or w in REPORTERS
            if w == "idiot":
                total += 5.0 * factor * (1.3 if place == "target" else 1.0)
            elif w in THREATS:
                total, place = total + (4.0 * 0 * factor), "threat" if place == "none" else place
                total += 4.0 * factor if place == "target" else 0
            elif w in TARGETS:
                total, place = total + (4.0 * factor if place == "threat" else 0), "target"
        got = scorer.features(" ".join(words))[0]
        assert abs(got - total) < 1e-9, (words, got, total)
