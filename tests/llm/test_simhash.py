import random

from stowage.llm.common import connected_components
from stowage.llm.simhash import fingerprint, keep_one, links, near_duplicates, similar_links, sketch


def roots_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 160)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = roots_of({x for p in pairs for x in p}, pairs)
    assert got == {n: r for n, r in want.items() if n in got}
    assert {n for p in pairs if p[0] != p[1] for n in p} == set(got)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def signed(x):
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def test_links_match_brute_force_with_and_without_dense_halves(spark):
    rnd = random.Random(2)
    prints = {signed(rnd.getrandbits(64)) for _ in range(40)}
    centre = rnd.getrandbits(64)
    for _ in range(150):  # one crowd around a centre: many share a half
        x = centre
        for _ in range(rnd.randrange(0, 5)):
            x ^= 1 << rnd.randrange(0, 40)
        prints.add(signed(x))
    pairs = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    exact = {tuple(sorted(r)) for r in links(nodes, dense=10**6).collect()}
    assert exact == {tuple(sorted(p)) for p in pairs}
    starred = [tuple(r) for r in links(nodes, dense=3).collect()]
    assert {tuple(sorted(p)) for p in starred} <= exact
    assert roots_of(prints, starred) == roots_of(prints, pairs)


def test_rows_nulls_and_names(spark):
    rows = [(5, "A b c d", "x"), (3, "a B  c\td", "y"), (9, None, "z"), (8, "", None), (7, " \n", "q"), (1, "other words in here", "w"), (1, "other words in here", "w"), (None, "a b c d", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = near_duplicates(docs)
    assert got.columns == ["doc_id", "fp", "component_id"]
    found = sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=str)
    assert found == sorted([(5, 3), (3, 3), (9, 7), (8, 7), (7, 7), (1, 1), (1, 1), (None, 3)], key=str)
    assert fingerprint("") == fingerprint(None) == 0
    assert sorted(r["doc_id"] for r in keep_one(docs).collect()) == [1, 3, 7]
    assert near_duplicates(docs.where("false")).count() == 0


def test_long_text_and_non_ascii_case():
    assert fingerprint("É a b") != fingerprint("é a b")
    assert fingerprint("word " * 200_000) == fingerprint("word word word")


def test_near_copies_far_apart_are_linked(spark):
    """Edited copies by the thousand shingles of their text; a passage that all documents hold links nothing."""
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(4000)]
    common = " ".join(rnd.choices(vocabulary, k=60))
    texts = [" ".join(rnd.choices(vocabulary, k=240)) for _ in range(30)]
    rows = [(i, f"{t} {common}") for i, t in enumerate(texts)]
    for i in range(10):
        for c in range(4):
            words = rows[i][1].split()
            for at in rnd.sample(range(len(words)), 3):
                words[at] = "changed"
            rows.append((100 + 10 * c + i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, similar=0.8).collect()}
    assert got == {**{i: i % 10 if i >= 100 else i for i, _ in rows}, 500: 500, 501: 500}
    assert near_duplicates(docs.where("false"), similar=0.8).count() == 0
    for text in (rows[0][1], "a b", "", None, "a " * 100_000):
        assert sketch(text)[0] == fingerprint(text)


def shingle_sets(rows):
    words = {i: t.lower().split() for i, t in rows}
    return {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in words.items()}


def similar_pairs(rows):
    sets = shingle_sets(rows)
    return [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def test_hub_and_its_copies_and_boilerplate_equal_brute_force(spark):
    """Copies near their original but not each other; pairs that share little but what all documents hold."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(4000)]
    common = " ".join(rnd.choices(vocabulary, k=300))
    rows = []
    for g in range(4):
        hub = rnd.choices(vocabulary, k=400)
        rows.append((1000 * g + 500, " ".join(hub)))
        for c in range(30):
            copy = list(hub)
            for at in rnd.sample(range(10, 390, 10), 7):
                copy[at] = f"new{g}x{c}x{at}"
            rows.append((1000 * g + c, " ".join(copy)))
    for i in range(20):
        own = rnd.choices(vocabulary, k=45)
        rows += [(5000 + i, f"{common} {' '.join(own)}"), (6000 + i, f"{common} {' '.join(own[:40])} {' '.join(rnd.choices(vocabulary, k=5))}")]
    pairs = similar_pairs(rows)
    want = roots_of([i for i, _ in rows], pairs)
    assert len(set(want.values())) < len(rows) / 2
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similar=0.8)
    prints = {r["doc_id"]: r["fp"] for r in got.collect()}
    close = [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 3]
    want = roots_of(prints, pairs + close)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_rows_without_an_id_of_their_own(spark):
    """A group without ids keeps one row; of two texts with one id only the one that is no copy stays."""
    rows = [(None, "lonely words of one text"), (None, "twin words are here now"), (None, "twin words are here now"), (None, "held by an id too"), (4, "held by an id too"), (5, "held by an id too"), (5, "another text of that id")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    want = [(4, "held by an id too"), (5, "another text of that id"), (None, "lonely words of one text"), (None, "twin words are here now")]
    assert sorted((tuple(r) for r in kept.collect()), key=str) == want


def test_holders_of_a_key_dealt_to_many_tasks(spark, monkeypatch):
    """A crowd of copies is linked the same when its keys' holders meet the pivots in many tasks."""
    rnd = random.Random(13)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(4000)]
    hub = rnd.choices(vocabulary, k=300)
    rows = [(1000, " ".join(hub)), (2000, " ".join(rnd.choices(vocabulary, k=300)))]
    for c in range(60):
        copy = list(hub)
        for at in rnd.sample(range(10, 290, 10), 4):
            copy[at] = f"new{c}x{at}"
        rows.append((c, " ".join(copy)))
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string")
    want = {i: 2000 if i == 2000 else 0 for i, _ in rows}
    for split in (2, 256):
        monkeypatch.setattr("stowage.llm.simhash.SPLIT", split)
        got = near_duplicates(docs, similar=0.8).collect()
        assert len(got) == len(rows) + 3 and {r["doc_id"]: r["component_id"] for r in got} == want


def test_pairs_in_a_crowd_of_boilerplate(spark):
    """Texts of one long boilerplate, in pairs that are near copies, in larger groups and alone: at least 0.95 of the pairs end in one group, and nothing else does."""
    rnd = random.Random(17)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(20_000)]
    common, draw = " ".join(rnd.choices(vocabulary, k=1000)), lambda k: " ".join(rnd.choices(vocabulary, k=k))
    rows, group = [], {}
    for g, size in enumerate([2] * 150 + [30] * 3 + [1] * 30):
        shared = draw(160)
        for _ in range(size):
            group[len(rows)] = g
            rows.append((len(rows), f"{common} {shared} {draw(60)}"))
    sets = shingle_sets(rows)
    similar = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert all(similar(2 * i, 2 * i + 1) for i in range(150)) and not any(similar(i, j) for i in range(0, 60, 7) for j in group if group[i] != group[j])
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similar=0.8).collect()
    got, prints = {r["doc_id"]: r["component_id"] for r in found}, {r["doc_id"]: r["fp"] for r in found}
    close = [(i, j) for i in group for j in group if i < j and ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 3]
    pairs = [(i, j) for i in group for j in group if i < j and group[i] == group[j]]
    recall = sum(got[i] == got[j] for i, j in pairs) / len(pairs)
    print("recall", recall, sum(got[2 * i] == got[2 * i + 1] for i in range(150)))
    assert recall >= 0.95 and sum(got[2 * i] == got[2 * i + 1] for i in range(150)) >= 0.95 * 150
    most = roots_of(prints, pairs + close)
    assert all(most[i] == most[c] for i, c in got.items())


def test_kept_rows_of_tables_with_any_names(spark):
    rows = [(1, "one text of some words", 1, 2, 3), (1, "one text of some words", 4, 5, 6), (None, "one text of some words", 7, 8, 9), (2, "other", 1, 1, 1)]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string, _id0 int, _row0 int, _kept int"))
    assert kept.columns == ["doc_id", "text", "_id0", "_row0", "_kept"] and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_all_holders_of_a_key_are_decided(spark):
    """Crowds of one key whose pivots are alone: similar sets are linked, also where all that they share is held by most, and however the pivots fare."""
    sketch_type = "rid long, fp long, sid long, n int, bands array<long>, five array<int>"
    common = list(range(100_000, 100_080))  # 80 of a crowd's shingles; two sets with ten more each are 0.8 similar
    fresh = iter(range(1_000_000))
    draw = lambda k: [next(fresh) for _ in range(k)]
    for crowd, keyed in ((3, False), (40, True)):
        sets, band = [], {}
        for i in range(42):
            sets.append(common + draw(40 if i not in (20, 21) else 10))
        shared = [draw(90) for _ in range(4)]
        for g in range(4):  # of a hundred shingles, ninety are a group's, and others of these are held by one that is alone
            sets += [shared[g] + draw(10) for _ in range(crowd)] + [shared[g][:20] + draw(80)]
        for i in (7, 8):  # linked by another key
            sets[i] = common + draw(5)
            band[i] = 777
        rows = [(i, 10 * i, (i * 7919) % 10_007, len(x), [1, band.get(i, 5000 + i)], x) for i, x in enumerate(sets)]
        rows = [r for r in rows if keyed or r[0] not in band]
        got = {r["node"]: r["root"] for r in similar_links(spark.createDataFrame(rows, sketch_type), spark.createDataFrame([], "u long, v long")).collect()}
        known = {r[1]: set(r[5]) for r in rows}
        pairs = [(a, b) for a in known for b in known if a < b and 5 * len(known[a] & known[b]) >= 4 * len(known[a] | known[b])]
        assert (200, 210) in pairs and {a: got.get(a, a) for a in known} == roots_of(known, pairs)


def test_texts_are_not_shuffled_to_leave_copies_out(spark, monkeypatch):
    """The same rows stay, by a broadcast of the copies' ids or, where these are many, by a shuffle."""
    rows = [(i, f"some words of the text {i % 7} are here and {i % 7 * 31} more") for i in range(40)] + [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = keep_one(docs, similar=None)
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
        want = sorted(r["doc_id"] for r in kept.collect())
        assert want == [*range(7), 50]
        monkeypatch.setattr("stowage.llm.simhash.IDS", 0)
        assert sorted(r["doc_id"] for r in keep_one(docs, similar=None).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
