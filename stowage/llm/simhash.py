"""Near-duplicates by SimHash and multi-index hashing.

Fingerprints are 64 bits over 3-word shingles. Two differ in at most 3 bits
only if one of their 32-bit halves differs in at most 1 bit, so each
fingerprint looks up the Hamming ball of radius 1 of either half in a table of
halves and checks the whole distance of what it meets.

Equal fingerprints are one node, whatever their number, so exact copies cost
nothing after the first group-by. A half that more than `dense` different
fingerprints share is not joined pairwise: its fingerprints meet at the points
of small balls in the other half (at most 529 of them at a point, by
counting), and each point gives links to one member. Components are the same
as with all pairs.

The pipeline's stage also links documents whose sets of 5-word shingles have a
Jaccard similarity of 0.8 or more, which may lie many bits apart. Candidates
for that share one of BANDS keys of ROWS least hashes each (a pair of
similarity 0.8 shares none with a chance of 0.0023); all holders of a key are
decided on whole sets, or are linked already (similar_links).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import connected_components, durable, stored, text_slices

WORDS, SEED, BITS = 3, 42, 3
#: Different fingerprints that share a half and are still joined pairwise.
DENSE = 64
#: Similarity of two sets of 5-word shingles that makes them near copies.
SIMILAR = 0.8
#: Keys by least hashes of a set, least hashes of a key.
BANDS, ROWS = 20, 6
#: Holders of a key that are all compared with each other.
BLOCK = 16
#: A shingle that is one in so many of a crowd's is joined by broadcast; there are no more such shingles than that.
HOT = 1000
#: Holders of a key that meet its pivots in one task, on average; those of a key with more are dealt to more tasks.
SPLIT = 256
#: So many ids are broadcast (some 64 bytes each) to pick rows; with more, the rows' texts or sets are shuffled.
IDS = 2_000_000
_RANDOM = np.random.default_rng(SEED)
_MULTIPLY = (_RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * 2 + 1).astype(np.uint32)
_FLIP = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_FOLD = (_RANDOM.integers(0, 1 << 62, ROWS, np.uint64) * 2 + 1).astype(np.uint64)


def _shingles(text: str | None) -> np.ndarray:
    """Hashes of the 3-word shingles, repeats included; of fewer words the one of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(w) for w in zip(*(words[i:] for i in range(WORDS)))]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(ones: np.ndarray, n) -> np.ndarray:
    return np.packbits(2 * ones > n, axis=-1, bitorder="little").view(np.int64)


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the whole text; 0 without words."""
    h = _shingles(text)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += _ones(h[i : i + 65536]).sum(0, dtype=np.int64)
    return int(_majority(ones, len(h))[0])


def sketch(text: str | None) -> tuple[int, np.ndarray]:
    """Fingerprint and sorted set of 32-bit hashes of the 5-word shingles; of fewer words, of the 3-word shingles."""
    h = _shingles(text)
    if not len(h):
        return 0, np.zeros(0, np.uint32)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += _ones(h[i : i + 65536]).sum(0, dtype=np.int64)
    five = (h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[2:] * np.uint64(0xC2B2AE3D27D4EB4F)) if len(h) > 2 else h
    return int(_majority(ones, len(h))[0]), np.unique((five >> np.uint64(32)).astype(np.uint32))


def bands(five: np.ndarray) -> np.ndarray:
    """BANDS keys of a set that is not empty: equal ones hold equal least hashes."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(five), 2048):
        np.minimum(least, ((five[i : i + 2048, None] ^ _FLIP) * _MULTIPLY).min(0), out=least)
    return ((least.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _FOLD).sum(1, dtype=np.uint64).view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches):
        fps = [fingerprint(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(fps, pa.int64())], ["doc_id", "mark", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (bigint) for each row; a null or blank text has fp 0."""
    return _rows(docs).mapInArrow(_batches, "doc_id bigint, mark bigint, fp bigint").drop("mark")


def _rows(docs: DataFrame, mark: str | None = None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), (F.col(mark) if mark else F.lit(None)).cast("bigint").alias("mark"), F.col("text").cast("string"))


def _half(fp: str | F.Column, side: int) -> F.Column:
    fp = F.col(fp) if isinstance(fp, str) else fp
    return F.shiftrightunsigned(fp, 32) if side == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(radius: int) -> list[int]:
    """Masks of 32 bits with at most `radius` ones."""
    masks = [0]
    one = [1 << i for i in range(32)]
    if radius >= 1:
        masks += one
    if radius >= 2:
        masks += [a | b for i, a in enumerate(one) for b in one[:i]]
    return masks


def _longs(values: list[int]) -> F.Column:
    return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")")


def links(nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges u, v that connect exactly what links at 3 or fewer bits connect.

    nodes: distinct fp. Beyond dense halves every link itself is returned.
    """
    key = lambda side: _half("fp", side).bitwiseOR(F.lit(side << 32))
    stored = nodes.select("fp", F.explode(F.array(key(0), key(1))).alias("key"))
    many = stored.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("key", F.lit(True).alias("dense"))
    marked = stored.join(many, "key", "left")
    shelf = marked.where("dense is null").select("key", F.col("fp").alias("other")).union(many.select("key", F.lit(None).cast("bigint")))
    probes = nodes.select("fp", F.explode(F.array(key(0), key(1))).alias("own")).select("fp", "own", F.explode(_longs(_ball(1))).alias("mask"))
    probes = probes.select("fp", F.col("own").bitwiseXOR(F.col("mask")).alias("key"))
    near = (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= BITS)
    met = durable(probes.join(shelf, "key").where(F.col("other").isNull() | near))
    pairs = met.where("other is not null").select(F.col("fp").alias("u"), F.col("other").alias("v"))
    crowd = met.where("other is null").select("key", "fp")
    return pairs if crowd.isEmpty() else pairs.union(_dense_links(crowd)).distinct()


def _dense_links(crowd: DataFrame) -> DataFrame:
    """Star links of dense halves. crowd: key and each fp whose half is within one bit of it."""
    side = F.shiftrightunsigned("key", 32)
    half = F.when(side == 0, _half("fp", 0)).otherwise(_half("fp", 1))
    rest = F.when(side == 0, _half("fp", 1)).otherwise(_half("fp", 0))
    inside = half == F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    crowd = crowd.select("key", "fp", rest.alias("rest"), inside.alias("inside"))
    balls = F.when(F.col("inside"), _longs(_ball(2))).otherwise(_longs(_ball(1)))
    points = crowd.select("key", "fp", "rest", "inside", F.explode(balls).alias("mask"))
    points = points.select("key", F.col("rest").bitwiseXOR(F.col("mask")).alias("at"), "fp", (F.col("inside") & (F.bit_count("mask") <= 1)).alias("centre"))
    met = points.groupBy("key", "at").agg(F.min(F.when(F.col("centre"), F.col("fp"))).alias("u"), F.collect_set("fp").alias("all"))
    return met.where("u is not null and size(all) > 1").select("u", F.explode("all").alias("v")).where("u <> v")


def _lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(kind)))


_SKETCH = "doc_id bigint, mark bigint, fp bigint, sid bigint, n int, bands array<bigint>, five array<int>"


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, mark, fp, sid (hash of the shingle set), n (its size), bands, five (the set)."""
    for b in text_slices(batches):
        got = [sketch(t) for t in b.column("text").to_pylist()]
        fives = [five for _, five in got]
        sids = np.array([xxhash.xxh64_intdigest(five.tobytes()) for five in fives], np.uint64).view(np.int64)
        keys = [bands(five) if len(five) else np.zeros(0, np.int64) for five in fives]
        columns = [pa.array([fp for fp, _ in got], pa.int64()), pa.array(sids), pa.array([len(five) for five in fives], pa.int32()), _lists(keys, np.int64), _lists(fives, np.int32)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), *columns], ["doc_id", "mark", "fp", "sid", "n", "bands", "five"])


def _verified(pairs: DataFrame, whole: DataFrame, similar: float) -> DataFrame:
    """u, v (fp) of the pairs a, b of sids whose whole sets are similar enough."""
    side = lambda x: whole.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("fp").alias(f"f{x}"), F.col("five").alias(f"s{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return durable(met.where(F.col("both") >= (F.col("na") + F.col("nb") - F.col("both")) * similar - 1e-9).select(F.col("fa").alias("u"), F.col("fb").alias("v")))


def similar_links(sketches: DataFrame, near: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """node, root (fp): components of the edges near and of rows that share a key and whose shingle sets are at least that similar.

    sketches: rid, fp, sid, n, bands, five. Equal sets are one node. The
    holders of a key are first compared with two of them, of which one is the
    holder that meets most others in all its keys: the text that was copied, if
    it is there. Where that leaves a key's holders unconnected, all of them are
    compared up to BLOCK, and more of them with two further pivots. Crowds that
    still do not hold together, as texts that share a long boilerplate, then
    meet by the rare shingles that any pair of that similarity shares
    (prefixes), first up to BLOCK or with two, at last all that are left apart.
    So a group of copies costs its size, not its square, and is spread over
    tasks by that size; no holders of a key that are similar stay apart.
    """
    sketches = sketches.where("n > 0")
    one = durable(sketches.groupBy("sid").agg(F.min("rid").alias("rid"), F.max("n").alias("n"), F.min("fp").alias("fp"), F.max("fp").alias("most")))
    same = sketches.select("sid", "fp").distinct().join(one.where("fp <> most").select("sid", F.col("fp").alias("v")), "sid").select(F.col("fp").alias("u"), "v").where("u <> v").distinct()
    keyed = sketches.select("rid", "bands").join(one.select("rid", "sid", "n", "fp"), "rid").select("rid", "sid", "n", "fp", F.posexplode("bands").alias("t", "band"))
    keyed = keyed.select("rid", "sid", "n", "fp", F.xxhash64("t", "band").alias("key"))
    many = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    held = durable(keyed.join(many, "key"))
    sums = held.groupBy("sid").agg(F.sum("c").alias("meets"))
    held = stored(held.join(sums, "sid"))
    needed = _few(held.select("rid").distinct())
    whole = stored(sketches.select("rid", "sid", "n", "five").join(needed, "rid", "left_semi").join(one.select("rid", "fp"), "rid"))

    linked, rooted = near.union(same), held.withColumn("root", F.col("fp"))
    for turn in range(2):
        if turn:
            roots, linked, rooted = _joined(linked, held)
        other = F.struct("sid", "n", "root")
        mixed = F.xxhash64("sid", F.lit(turn))
        picks = [F.max_by(other, F.struct("meets", "sid")), F.min(other)] if turn == 0 else [F.max_by(other, mixed), F.min_by(other, mixed)]
        apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.array(*picks).alias("ps"), F.max("c").alias("c")).where("lo <> hi")
        apart = apart.select("key", "ps", F.explode(F.sequence(F.lit(0), F.floor(F.col("c") / SPLIT))).alias("part"))  # one row more for each SPLIT holders
        dealt = rooted.select("key", "sid", "n", "root", "c", F.pmod(F.xxhash64("sid"), 1 + F.floor(F.col("c") / SPLIT)).alias("part"))
        met = dealt.join(apart, ["key", "part"])
        few = F.col("c") <= BLOCK if turn == 1 else F.lit(False)
        pairs = met.where(~few).select("sid", "n", "root", F.explode("ps").alias("p")).select("sid", "n", "root", F.col("p.sid").alias("o"), F.col("p.n").alias("m"), F.col("p.root").alias("oroot"))
        if turn == 1:
            small = met.where(few).select("key", "sid", "n", "root")
            others = small.select("key", F.col("sid").alias("o"), F.col("n").alias("m"), F.col("root").alias("oroot"))
            pairs = pairs.union(small.join(others, "key").where("sid < o").select("sid", "n", "root", "o", "m", "oroot"))
        found = _decided(pairs, whole, similar)
        if found is not None:
            linked = linked.union(found)
    if found is not None:
        roots, linked, rooted = _joined(linked, held.where(F.col("c") > BLOCK))
    else:
        rooted = rooted.where(F.col("c") > BLOCK)
    apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    crowd = durable(rooted.join(apart, "key", "left_semi").select("rid").distinct())
    if crowd.isEmpty():
        return roots
    shelf = prefixes(whole.join(crowd, "rid", "left_semi"), similar)
    for every in (False, True):
        _, linked, rooted = _joined(linked, shelf, roots)
        found = _decided(_met(rooted, similar, every), whole, similar)
        if found is not None:
            linked = linked.union(found)
            roots = durable(connected_components(linked))
    return roots


def _few(ids: DataFrame) -> DataFrame:
    """The ids, computed once, to be broadcast unless there are more than IDS."""
    ids = durable(ids)
    return F.broadcast(ids) if ids.count() <= IDS else ids


def _decided(pairs: DataFrame, whole: DataFrame, similar: float) -> DataFrame | None:
    """Links of the candidates sid, n, root, o, m, oroot that are of different roots and similar enough; None if there are none."""
    fits = lambda a, b: F.col(a) >= F.col(b) * similar - 1e-9
    pairs = durable(pairs.where((F.col("root") != F.col("oroot")) & fits("n", "m") & fits("m", "n")).select(F.least("sid", "o").alias("a"), F.greatest("sid", "o").alias("b")).distinct())
    if pairs.isEmpty():
        return None
    found = _verified(pairs, whole, similar)
    return None if found.isEmpty() else found


def prefixes(sets: DataFrame, similar: float) -> DataFrame:
    """sid, n, fp, f, at, low: the shingles f by which sets (sid, n, fp, five) that are similar enough must meet.

    The shingles of a set are numbered (at) by how many sets hold them, rarest
    first, in one order for all. The first that two similar sets share leaves
    no less than their overlap in either: it is among the first n - similar n +
    1 of both, and low, nearer to the front still, in the smaller. Shingles of
    one set alone are numbered, but no two sets meet there.
    """
    held = stored(sets.select("sid", F.explode("five").alias("f")))
    counts = stored(held.groupBy("f").agg(F.count("*").alias("df")).where("df > 1"))
    total = held.count()
    hot = F.broadcast(counts.where(F.col("df") * HOT >= total))  # HOT rows at most
    known = held.join(hot, "f").unionByName(held.join(hot, "f", "left_anti").join(counts.where(F.col("df") * HOT < total), "f"))
    order = F.array_sort(F.collect_list(F.struct("df", F.xxhash64("f").alias("mix"), "f"))).alias("all")
    ranked = known.groupBy("sid").agg(order).join(sets.select("sid", "n", "fp"), "sid")
    placed = ranked.select("sid", "n", "fp", F.size("all").alias("known"), F.posexplode("all").alias("k", "e"))
    placed = placed.select("sid", "n", "fp", F.col("e.f").alias("f"), (F.col("n") - F.col("known") + F.col("k")).alias("at"))
    rest = F.col("n") - F.col("at")
    low = rest * (1 + similar) >= F.col("n") * (2 * similar) - 1e-6
    return stored(placed.where(rest >= F.col("n") * similar - 1e-6).withColumn("low", low))


def _met(shelf: DataFrame, similar: float, every: bool) -> DataFrame:
    """Candidates sid, n, root, o, m, oroot among prefixes with their root: all holders of a shingle up to BLOCK, more of them with two; or, of those more, all (every).

    The smaller sets of a shingle with many holders are dealt to tasks by
    SPLIT, each of which meets all the larger ones.
    """
    mixed, who = F.xxhash64("sid", F.lit(2)), F.struct("sid", "n", "root")
    apart = shelf.groupBy("f").agg(F.count("*").alias("h"), F.max("low").alias("some"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.array(F.max_by(who, mixed), F.min_by(who, mixed)).alias("ps")).where("lo <> hi and some")
    many = F.col("h") > BLOCK
    each = apart.where(many if every else ~many).select("f", F.floor(F.col("h") / SPLIT).alias("parts"))
    held = shelf.join(each, "f")
    small = held.where("low").withColumn("part", F.pmod(F.xxhash64("sid"), 1 + F.col("parts"))).select("f", "part", "sid", "n", "at", "root")
    large = held.select("f", F.explode(F.sequence(F.lit(0), F.col("parts"))).alias("part"), F.col("sid").alias("o"), F.col("n").alias("m"), F.col("at").alias("oat"), F.col("root").alias("oroot"))
    rest = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("oat"))
    both = small.join(large, ["f", "part"]).where("root <> oroot and (n < m or n = m and sid < o)").where(rest * (1 + similar) >= (F.col("n") + F.col("m")) * similar - 1e-6)
    names = ["sid", "n", "root", "o", "m", "oroot"]
    if every:
        return both.select(*names)
    stars = shelf.join(apart.where(many).select("f", "ps"), "f").select("sid", "n", "root", F.explode("ps").alias("p"))
    return both.select(*names).union(stars.select("sid", "n", "root", F.col("p.sid").alias("o"), F.col("p.n").alias("m"), F.col("p.root").alias("oroot")))


def _joined(linked: DataFrame, held: DataFrame, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components of the links (roots, if they are known), the same as links, and held with its root."""
    roots = durable(connected_components(linked)) if roots is None else roots
    rooted = held.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return roots, roots.select(F.col("root").alias("u"), F.col("node").alias("v")), rooted


def near_duplicates(docs: DataFrame, dense: int = DENSE, similar: float | None = None) -> DataFrame:
    """doc_id, fp, component_id for each row.

    Null texts, blank texts: fp 0, linked like any other. Rows that repeat a
    doc_id stay separate rows. A null doc_id takes part but names no component
    (its component_id is null if no other id is in it). Empty table: no rows.
    Other columns are ignored. With `similar`, rows of at least that 5-word
    similarity are linked too, however far apart their fingerprints (see similar_links).
    """
    return _grouped(_rows(docs), dense, similar).select("doc_id", "fp", "component_id")


def _grouped(rows: DataFrame, dense: int, similar: float | None) -> DataFrame:
    """doc_id, mark, fp, root, component_id for each of rows (doc_id, mark, text)."""
    if similar is None:
        prints = durable(rows.mapInArrow(_batches, "doc_id bigint, mark bigint, fp bigint"))
        nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
        roots = connected_components(links(nodes.select("fp"), dense))
    else:
        sketches = stored(rows.mapInArrow(_sketch_batches, _SKETCH).withColumn("rid", F.monotonically_increasing_id()))
        prints = sketches.select("doc_id", "mark", "fp")
        nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
        roots = similar_links(sketches, durable(links(nodes.select("fp"), dense)), similar)
    rooted = nodes.select("fp", "least").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "mark", "fp", "root", "component_id")


def keep_one(docs: DataFrame, similar: float | None = SIMILAR) -> DataFrame:
    """One row of each group: that of the least doc_id in it, one of them if rows repeat that id, any one of a group without ids.

    Rows without a doc_id of their own are stored with a row number and are
    kept or left out by it. Columns of docs may have any names. The texts are
    not shuffled while the copies' ids are few enough to be broadcast.
    """
    taken = set(docs.columns)
    id_, row = (next(n for n in (f"_{x}{i}" for i in range(len(taken) + 1)) if n not in taken) for x in ("id", "row"))
    own = F.col("doc_id").cast("bigint")
    repeated = stored(docs.groupBy(own.alias(id_)).agg(F.count("*").alias("n")).where(f"n > 1 or {id_} is null").select(id_))
    plain, odd = docs, None
    if not repeated.isEmpty():
        plain = docs.join(repeated, own.eqNullSafe(F.col(id_)), "left_anti")
        odd = stored(docs.join(repeated, own.eqNullSafe(F.col(id_)), "left_semi").withColumn(row, F.monotonically_increasing_id()))
    rows = _rows(plain) if odd is None else _rows(plain).union(_rows(odd, row))
    grouped = durable(_grouped(rows, DENSE, similar))
    copies = _few(grouped.where("doc_id <> component_id and mark is null").select(F.col("doc_id").alias(id_)))
    one = plain.join(copies, own == F.col(id_), "left_anti")
    if odd is None:
        return one
    marks = grouped.where("mark is not null and (doc_id = component_id or component_id is null)").groupBy("root").agg(F.min("mark").alias(id_)).select(id_)
    return one.union(odd.join(marks, F.col(row) == F.col(id_), "left_semi").drop(row))


def op3_simhash_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
