import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pointweave.llm import divergence, shuffled_shards, sketch_search, slice_search, url_filter
from pyspark.sql import functions as F

BIG = (1 << 53) + 1


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# op11


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def ranked(docs, items, limit):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:limit])]
    return sorted(out, key=str)


def documents(rng, n):
    words = [f"w{k}" for k in range(60)] + ["Éa", "éa", "X1", "x1"]
    docs = [(BIG + 3 * k, " ".join(rng.choices(words, weights=range(64, 0, -1), k=rng.randint(0, 40)))) for k in range(n)]
    docs += [(None, "w1 w2 w2"), (None, "w3"), (5, None), (6, ""), (7, "-- !"), (8, "w2 w2"), (8, "w2 w2"), (9, "W2 w2")]
    return docs + [(10, "w5 " * 3000 + "rare"), (11, " ".join(f"u{k}" for k in range(5000)) + " w7 w7"), (12, "w9" * 3000)]


@pytest.mark.parametrize("a_pass", [2048, 3])
def test_search_equals_scoring_every_document(spark, monkeypatch, a_pass):
    monkeypatch.setattr(sketch_search, "ITEMS_A_PASS", a_pass)
    rng = random.Random(a_pass)
    docs = documents(rng, 150)
    items = [(k, " ".join(rng.choices([f"w{j}" for j in range(40)] + ["nowhere", "ÉA"], k=6))) for k in range(8)] + [(8, None), (9, ""), (None, "w5 rare"), (2, "w2 W2 w2"), (11, "w9" * 3000), (12, "rare nowhere u77")]
    table = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, row int, item int, score int").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = sketch_search.searched(table, asked, 7)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, 7)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("false"), items.filter("false"))):
        got = sketch_search.searched(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_bounds_are_never_below_scores():
    rng = random.Random(3)
    texts = [t for _, t in documents(rng, 60)]
    counts = [Counter(sketch_search.plain_words(t)) for t in texts]
    df = Counter(t for c in counts for t in c)
    asked = {k: set(rng.sample(sorted(df), 9)) for k in range(12)} | {99: {b"w5", b"rare"}}
    queries = sketch_search.Queries(asked, df, sum(map(bool, counts)), sum(sum(c.values()) for c in counts))
    sizes = np.array([sum(c.values()) for c in counts])
    sketches = [sketch_search.fold(sketch_search.word_hashes(list(c)), np.fromiter(c.values(), np.int64, len(c))).tobytes() for c in counts]
    bounds = queries.bounds(sketches, sizes)
    exact = np.array([[queries.score(q, c, int(n)) for q in range(len(queries.items))] for c, n in zip(counts, sizes)])
    assert (bounds >= exact).all() and (bounds == exact).mean() > 0.5
    assert max(c[b"w5"] for c in counts) > sketch_search.MANY


# op12


def test_slices_add_select_and_compare():
    rng = np.random.default_rng(1)
    values = rng.integers(-(1 << 9), 1 << 9, (150, 3))
    bitmaps, kept, shift, spread = slice_search.sliced(values, 4)
    upper = np.zeros((3, 150), np.int64)
    for b in range(kept):
        upper += np.unpackbits(bitmaps[:, b].view(np.uint8), axis=1, bitorder="little")[:, :150].astype(np.int64) << b
    assert (upper.T == (values >> shift) + 8).all() and kept == 4 and shift == 6
    rest = values - ((values >> shift) << shift) - 31.5
    assert spread == pytest.approx(np.sqrt((rest**2).sum(axis=1)).max())
    numbers = rng.integers(0, 2, (5, 7, 128)).astype(np.uint8)  # seven bitmaps of each of five weights
    sums = slice_search.added([slice_search.packed(n) for n in numbers])
    wanted = sum((numbers[w].sum(axis=0).astype(np.int64) << w) for w in range(5))
    got = sum(np.unpackbits(s.view(np.uint8), bitorder="little").astype(np.int64) << b for b, s in enumerate(sums))
    assert (got == wanted).all()
    some = np.zeros(128, np.uint8)
    some[:100] = 1
    rows, order = slice_search.packed(some), np.sort(wanted[:100])[::-1]
    for k in (1, 2, 17, 100):
        assert slice_search.kth_value(sums, rows, k) == order[k - 1]
    for bound in (-3, 0, int(order[40]), int(order[0]) + 1, 1 << 40):
        held = np.unpackbits(slice_search.at_least(sums, rows, bound).view(np.uint8), bitorder="little")
        assert (np.flatnonzero(held) == np.flatnonzero((wanted >= bound) & (some == 1))).all()


def best_products(rows, limit, every):
    sound = [(k, i, [math.floor(256 * float(x)) for x in v]) for k, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, q in sound:
        if i is not None and i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0, j) for o, j, v in sound if o != k and len(v) == len(q))
            out += [(i, r + 1, n[3], -n[0]) for r, n in enumerate(near[:limit])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "slices", "query_bytes"), [(1 << 20, 6, 1 << 20), (4096, 2, 900), (4096, 1, 1 << 20)])
def test_top_products_equal_every_pair(spark, monkeypatch, block, slices, query_bytes):
    monkeypatch.setattr(slice_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(slice_search, "QUERY_BYTES", query_bytes)
    rng = random.Random(slices)
    rows = [(BIG - 1 + k, [rng.gauss(0, 0.4) for _ in range(9)]) for k in range(400)]
    rows += [(4, [0.5] * 9)] * 8 + [(None, [0.5] * 9), (8, [0.0] * 9), (12, None), (16, []), (20, [float("nan")] * 9), (24, [1.0] * 8 + [None]), (28, [1.0] * 8 + [float("inf")]), (32, [300.0, -2.0, 0.004]), (36, [-1.0, 2.0, 7.0]), (3, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, key int, score int").repartition(3)
    got = slice_search.nearest(table, 5, 4, slices)
    assert sorted(map(tuple, got.collect()), key=str) == best_products(rows, 5, 4)


def test_products_of_an_empty_table_and_beyond_64_bits(spark):
    empty = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>").limit(0)
    assert slice_search.nearest(empty).columns == ["query_id", "rank", "vec_id", "score"] and slice_search.nearest(empty).count() == 0
    great = spark.createDataFrame([(50, [2.0**40] * 2), (51, [2.0**40] * 2)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        slice_search.nearest(great).count()


# op13


def test_perfect_hash_has_a_slot_a_term_and_knows_strangers():
    rng = random.Random(2)
    terms = sorted({bytes(rng.choices(range(97, 123), k=rng.randint(1, 6))) for _ in range(4000)})
    for levels in (40, 2, 0):  # few levels leave terms to the list
        made = divergence.PerfectHash.build(terms, levels)
        assert sorted(made.slots(terms).tolist()) == list(range(len(terms)))
        strangers = [b"0" + t for t in terms]
        assert (made.slots(strangers) == -1).all()
        assert made.slots([]).tolist() == []
    assert divergence.PerfectHash.build([]).slots([b"a"]).tolist() == [-1]


def audit(docs, least, best):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for lang, source, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        counts = defaultdict(Counter)
        for _, source, terms in (d for d in docs if d[0] == lang):
            counts[source].update(t for t in terms if df[t] >= least)
        share = lambda c: {t: 1 + (10**9 * (c[t] + 2)) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        far = lambda p, q: (p - q) ** 2 // (p + q)
        shares, whole = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s, p in shares.items():
            pairs = [(-sum(far(p[t], q[t]) for t in kept), o.encode(), o) for o, q in shares.items() if o != s]
            terms = [(-far(p[t], whole[t]), t.encode(), t) for t in kept if counts[s][t] and p[t] > whole[t]]
            out += [(lang, s, part, x[2], -x[0], k + 1) for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:best])) for k, x in enumerate(rows)]
    return sorted(out)


@pytest.mark.parametrize(("a_shard", "pass_bytes", "slots", "sources"), [(1 << 15, 64 << 20, 4096, 128), (7, 300, 3, 2)])
def test_audit_equals_its_definition(spark, monkeypatch, a_shard, pass_bytes, slots, sources):
    monkeypatch.setattr(divergence, "TILE_SLOTS", slots)
    monkeypatch.setattr(divergence, "TILE_SOURCES", sources)
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    monkeypatch.setattr(divergence, "SLOT_BYTES", 400)
    rng = random.Random(9)
    words = [f"t{chr(97 + k)}" for k in range(20)] + ["Ä", "ä", "ñu", "A1b", "z"]
    docs = [(rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "dé", None, ""]), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(160)]
    docs += [("xx", "only", "once here"), ("yy", "a", None), ("yy", "b", ""), ("en", "long", "ta tb " * 4000)] + [("en", "a", "same same")] * 6
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "lang string, source string, text string, number int, slot int").repartition(4)
    got = divergence.audited(table, 4, 3, a_shard, pass_bytes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audit(docs, 4, 3)


def test_audit_of_an_empty_table_and_great_counts(spark):
    assert divergence.audited(spark.createDataFrame([("en", "a", "x")], "lang string, source string, text string").limit(0)).count() == 0
    rows = [(9 * 10**12, 9 * 10**13, 10**6), (0, 1, 1), (5, 7, 3), (10**13, 10**13, 1)]
    got = spark.createDataFrame(rows, "n long, total long, kept long").select(divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    wanted = [1 + 10**9 * (n + 2) // (t + 2 * k) for n, t, k in rows]
    assert [r["p"] for r in got.collect()] == wanted
    assert divergence._shares(np.array([r[0] for r in rows]), np.array([r[1] + 2 * r[2] for r in rows])).tolist() == wanted


# op4 and op10


def test_shards_keep_great_ids_beside_null_ones(spark, tmp_path):
    ids = [BIG + 2 * k for k in range(1000)] + [None] * 150 + [BIG]
    docs = spark.createDataFrame([(i, f"t{k % 7}" if k % 5 else None, "x") for k, i in enumerate(ids)], "doc_id long, text string, position string")
    shuffled_shards.write_shards(docs, str(tmp_path / "s"), 5)
    rows = shuffled_shards.read_shards(spark, str(tmp_path / "s")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(map(tuple, docs.select("doc_id", "text").collect()))
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and max(map(len, places.values())) - min(map(len, places.values())) <= 1


def test_names_are_split_with_very_long_words_of_the_crawl(spark):
    words = spark.createDataFrame([("blue", 9), ("berry", 9), ("z" * 3000, 1), ("zz", 5)], "word string, n long")
    names = spark.createDataFrame([("blueberry",), ("z" * 40,), ("q",)], "name string")
    got = {r["name"]: r["words"] for r in url_filter.name_segments(names, words).collect()}
    assert got["blueberry"] == ["blue", "berry"] and "".join(got["z" * 40]) == "z" * 40 and got["q"] == ["q"]
    assert url_filter.name_segments(names, words.limit(0)).count() == 3
