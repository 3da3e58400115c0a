import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointweave.llm import decontamination as dc
from pointweave.llm import licenses, quality, shuffled_shards, url_filter
from pointweave.plans.scratch import scratch_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# licenses

LICENSE_TEXTS = [
    None, "", "MIT License", "mit  license, MIT-License!", "submit license", "the Apache License, Version 2.0. GNU General Public License v3 mit licenses", "mit é license",
    "SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND Zlib)\nmit license", "spdx-license-identifier: (MIT", "SPDX license identifier", "a" * 100_000 + " mit license",
]


def test_license_digest_equals_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(LICENSE_TEXTS)] + [(None, "mit license", "x")]
    got = licenses.with_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert len(got) == len(rows)
    for r, (i, t, _) in zip(got, rows):
        words = WORD.findall(lower(t))
        places = [(k, label) for phrase, label in licenses.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        assert (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (i, len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert {label for _, label in places} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[7]["labels"] == "gpl-2.0,mit,zlib" and got[7]["score"] == 1.0
    assert licenses.with_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_expressions():
    value = lambda t: licenses.evaluate_expression(licenses.parse_expression(t)[0], {"a": 1.0, "b": 0.5, "c": 0.2})
    assert value("A OR B AND C") == 1.0 and value("(A OR B) AND C") == 0.2 and value("A AND B OR C") == 0.5
    assert value("c WITH x") == pytest.approx(0.6) and value("b AND c WITH x") == 0.5
    assert value("A and") == 1.0 and value("and A") is None and value("(A") is None and value("") is None and value("a b") == 1.0
    assert licenses.parse_expression("MIT or Apache-2.0+ (see file)")[0] == ["mit", "apache-2.0", "or"]


def test_long_expressions_are_read_whole(spark):
    tag = "SPDX-License-Identifier: "
    texts = [tag + "MIT AND " * 55 + "GPL-3.0-only", tag + "MIT AND " * 5000 + "(ISC OR GPL-2.0-only)\nAND Zlib", tag + "MIT " + "x" * 500 + " " + tag + "GPL-3.0-only", tag + "(A AND " * 3000 + "B" + ")" * 3000]
    got = licenses.with_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r["labels"], r["score"]) for r in got] == [("gpl-3.0,mit", 0.3), ("gpl-2.0,isc,mit", 1.0), ("gpl-3.0,mit", 0.3), ("a,b", licenses.UNKNOWN_FREEDOM)]
    assert licenses.parse_expression("a WITH (b AND c) OR d")[1] == ["a", "d"]


# urls

URLS = [
    None, "", "no scheme", "http://", "HTTP://Ab.Example.NET/en/x?q#f", "http://example.net/en/", "http://net/", "http://xnet/", "http://a.net", "http://a.net?x/", "http://a.org/fr/1#x/y", "x://a.org/frx",
    "http://www.example.com/de/5", "http://badexample.com/de/", "http://a.com/1://b.net/2", "http://a.org:80/fr/", "http://A\u00c9.org/fr/",
]


def judge(url):
    text = url or ""
    rest = text.partition("://")[2]
    host = lower(re.split("[/?#]", rest, maxsplit=1)[0])
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    best = None
    for verdict, rule in url_filter.RULES:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def test_rules_and_bayes_equal_brute_force(spark):
    html = "<p>the cheap pills shop the news net</p><script>zz zz</script>" * 3
    rows = [(i, u, html) for i, u in enumerate(URLS)] + [(None, URLS[5], None), (50, URLS[5], html)]
    rows += [(100 + i, f"http://cheappills.{'net' if i % 2 else 'com'}/shop/{i}", html) for i in range(6)] + [(200 + i, f"http://the-news.{'org' if i % 2 else 'com'}/fr/{i}", html) for i in range(6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = url_filter.judged_pages(df).collect()  # with a column host of its own
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    by_id = {r["page_id"]: r for r in got}
    counts = Counter(w for _, _, h in rows for w in re.findall(r"[^\W\d_]+", re.sub(r"(?s)<script.*?</script>|<[^>]*>", " ", h or "").lower()))
    total = sum(counts.values())

    def tokens(url):
        host, path, *_ = judge(url)
        out = []
        for name in re.findall(r"[^\W\d_]+", host):
            parts = [(a, b - a, counts[name[a:b]]) for a in range(len(name)) for b in range(a + 1, len(name) + 1) if name[a:b] in counts]
            out += ["h:" + w for w in url_filter.split_name(name, parts, total)]
        return out + ["p:" + ("0" if t.isdigit() else t) for t in re.findall(r"[^\W_]+", lower(path))]

    seen = {"block": Counter(), "allow": Counter()}
    pages = Counter()
    for _, u, _ in rows:
        verdict = judge(u)[3]
        if verdict:
            seen[verdict].update(tokens(u))
            pages[verdict] += 1
    vocabulary = {*seen["block"], *seen["allow"]}
    odds = lambda t: np.log((seen["block"][t] + 1) / (sum(seen["block"].values()) + len(vocabulary))) - np.log((seen["allow"][t] + 1) / (sum(seen["allow"].values()) + len(vocabulary)))
    for i, u, _ in rows:
        r, (host, path, rule, verdict) = by_id[i], judge(u)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        if rule is None:
            score = np.log((pages["block"] + 1) / (pages["allow"] + 1)) + sum(odds(t) for t in tokens(u) if t in vocabulary)
            assert r["block_score"] == pytest.approx(score, abs=1e-9)
            verdict = "block" if score > 0 else "allow"
        assert r["verdict"] == verdict
    assert by_id[100]["verdict"] == "block" and by_id[200]["verdict"] == "allow"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judged_pages(empty).count() == 0


def test_viterbi_prefers_likely_words():
    name, counts = "therapist", {"the": 50, "rapist": 1, "therapist": 5, "a": 10}
    parts = [(i, len(w), n) for w, n in counts.items() for i in range(len(name)) if name.startswith(w, i)]
    assert url_filter.split_name(name, parts, 100) == ["therapist"]
    assert url_filter.split_name("qq", [], 10) == ["qq"] and url_filter.split_name("", [], 10) == []


# shards


def test_shards_are_a_permutation_cut_evenly(spark):
    rows = [(i % 40, f"text {i % 60}") for i in range(500)] + [(7, "same")] * 300 + [(None, None), (None, None), (1, ""), (2, "é" * 1000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, shard int")
    paths = [scratch_path(spark, "s") for _ in range(2)]
    for path, part in zip(paths, (df, df.repartition(3))):
        shuffled_shards.write_shards(part, path, shards=7, bucket_bytes=200)
    one, two = ([tuple(r) for r in shuffled_shards.read_shards(spark, p).select("shard", "slot", "doc_id", "text").collect()] for p in paths)
    assert Counter((r[2], r[3]) for r in one) == Counter(rows) == Counter((r[2], r[3]) for r in two)
    sizes = Counter(r[0] for r in one)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r[1] for r in one if r[0] == k) == list(range(n)) for k, n in sizes.items())
    path = scratch_path(spark, "s")
    shuffled_shards.write_shards(spark.createDataFrame([], "doc_id long, text string"), path)


def test_same_seed_same_order_however_partitioned(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    orders = [[r["doc_id"] for r in shuffled_shards.shuffled(d, seed).orderBy("position").collect()] for d, seed in ((df, 1), (df.repartition(5), 1), (df, 2))]
    assert orders[0] == orders[1] != orders[2]
    assert abs(np.corrcoef(orders[0], range(3000))[0, 1]) < 0.08


def test_groups_of_buckets_leave_the_order_alone(spark, monkeypatch):
    df = spark.range(1500).selectExpr("id as doc_id", "repeat('text ', 20) as text")
    orders = []
    for groups, least in ((None, 40), (4000, 4)):
        monkeypatch.setattr(shuffled_shards, "LEAST_BUCKETS", least)
        if groups:
            monkeypatch.setattr(shuffled_shards, "GROUP_BYTES", groups)
            monkeypatch.setattr(shuffled_shards, "PARTITION_BYTES", 10_000)  # more partitions than the session asks for
        made = shuffled_shards.shuffled(df, 1, bucket_bytes=1500)
        orders.append([tuple(r) for r in made.orderBy("position").select("position", "doc_id").collect()])
    assert orders[0] == orders[1] and [p for p, _ in orders[0]] == list(range(1500))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(_group") <= 2  # of rows and of the counts; the texts move once


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(shuffled_shards.fisher_yates(3, [1, i])) for i in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850


def test_digest_columns(spark, tmp_path):
    spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in shuffled_shards.query(spark, str(tmp_path)).collect()}
    assert rows[1]["size"] == 10 and rows[1]["text_crc32"] == zlib.crc32("é".encode())
    assert rows[2]["size"] == 8 and rows[2]["text_crc32"] == 0 and rows[1]["law"] == "rows"


# decontamination


def aligned(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_alignment_equals_the_recurrence(a, b):
    best, end = dc.local_alignment(np.array(a, int), np.array(b, int))
    assert best == aligned(a, b) and 0 <= end <= len(b)


def test_copies_edits_and_clean_texts(spark):
    rng = np.random.default_rng(0)
    items = [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in (20, 30, 60, 12)]
    filler = lambda n: [f"f{x}" for x in rng.integers(0, 5000, n)]
    dropped = [w for k, w in enumerate(items[1]) if k % 6]
    swapped = [w if k % 5 else "zz" for k, w in enumerate(items[2])]
    docs = [
        (1, filler(50) + items[0] + filler(20)), (2, dropped), (3, filler(400) + swapped), (4, items[2][:15] + filler(30)), (5, filler(60)), (6, items[3]), (7, items[0] + filler(30) + items[1]), (None, items[0]),
        (8, items[0]), (8, items[0]), (9, []),
    ]
    df = spark.createDataFrame([(i, ", ".join(w).upper(), "x") for i, w in docs] + [(10, None, "x"), (11, "", "x")], "doc_id long, text string, words string")
    bench = spark.createDataFrame([(k, " ".join(w), "x") for k, w in enumerate(items)] + [(9, None, "x"), (10, "too short", "x"), (None, " ".join(items[0]), "x"), (0, " ".join(items[0]), "x")], "item_id long, text string, seed string")
    for limit in (dc.BROADCAST_SEEDS, 0):
        seeds = dc.item_seeds(bench)
        assert dc.seed_hits(df, seeds, broadcast_seeds=limit).count() >= 8
    got = {(r["doc_id"], r["item_id"]): r for r in dc.contaminated_passages(df, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 2), (6, 3), (7, 0), (7, 1), (None, 0), (8, 0)}
    assert got[1, 0]["score"] == 1.0 and (got[1, 0]["first_word"], got[1, 0]["last_word"]) == (50, 69)
    assert (got[7, 1]["first_word"], got[7, 1]["last_word"]) == (50, 79)
    kept = dc.decontaminated(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 9, 10, 11]
    assert dc.contaminated_passages(df.limit(0), bench).count() == 0 and dc.decontaminated(df, bench.limit(0)).count() == df.count()


def test_every_alignment_of_the_score_is_found(spark):
    rng = np.random.default_rng(3)
    words = lambda n, k=3000: [f"w{x}" for x in rng.integers(0, k, n)]
    items = [words(38), words(16), words(9), words(20, 12), [w for k in range(7) for w in (f"a{k}", f"b{k}", f"c{k}")], words(15)]
    docs = [words(20) + items[0][:20] + words(20) for _ in range(90)] + [items[0]] * 10
    for _ in range(60):
        i = int(rng.integers(0, 6))
        copy = []
        for w in items[i]:
            copy += [] if rng.random() < 0.1 else ["zz" if rng.random() < 0.3 else w]
            copy += ["yy"] if rng.random() < 0.2 else []
        docs.append(words(15) + copy + words(15, 12))
    docs += [[x for w in items[5] for x in (w, "yy")], [w if k % 3 < 2 else "zz" for k, w in enumerate(items[4])]]
    number = {w: k for k, w in enumerate(sorted({w for d in docs + items for w in d}))}
    coded = [np.array([number[w] for w in d]) for d in docs]
    want = {(i, k) for i, d in enumerate(coded) for k, item in enumerate(items) if dc.local_alignment(np.array([number[w] for w in item]), d)[0] >= len(item)}
    assert {i for i, k in want if k == 0} >= set(range(100)) and {(160, 5), (161, 4)} <= want
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in dc.contaminated_passages(df, bench).collect()} == want
    few = dc.seed_hits(df, dc.item_seeds(bench), broadcast_seeds=30)
    assert {(r["doc_id"], r["item_id"]) for r in few.collect()} == want


def test_rare_seeds_join_and_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    stem = words(12)
    items = [stem + words(26) for _ in range(300)] + [words(18) for _ in range(40)]
    docs = [words(30) + stem + words(30) for _ in range(20)] + [words(10) + items[k][k % 17 : 38 - k % 3] + words(10) for k in range(0, 340, 7)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)] + [(900, None), (901, "one")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    index = dc.SeedIndex(dc.item_seeds(bench).toArrow())
    counts = dc.document_counts(df, index)
    slots = [np.unique(index.seeds_of(dc.word_hashes([w.encode() for w in d]), np.array([0, len(d)]))[1]) for d in docs]
    assert counts.tolist() == np.bincount(np.concatenate(slots), minlength=len(index.pairs)).tolist()
    index.ranked(counts)
    assert max(counts) >= 20 and sum(len(index._with_rare_seeds(s)) for s in slots[:20]) <= 20  # the stem's seeds would join 300 items to each
    number = {w: k for k, w in enumerate(sorted({w for d in docs + items for w in d}))}
    coded = [np.array([number[w] for w in d]) for d in docs]
    want = {(i, k) for i, d in enumerate(coded) for k, item in enumerate(items) if dc.local_alignment(np.array([number[w] for w in item]), d)[0] >= len(item)}
    assert len(want) >= 40
    for hits in (1, 2, 50):
        monkeypatch.setattr(dc, "RARE_HITS", hits)
        assert {(r["doc_id"], r["item_id"]) for r in dc.contaminated_passages(df, bench).collect()} == want


def test_short_items_are_found_whole(spark):
    bench = spark.createDataFrame([(0, "What is the capital?"), (1, "Yes"), (2, "\u6771\u4eac\u306f\u9996\u90fd"), (3, "one two three four five six seven"), (4, "...")], "item_id long, text string")
    texts = ["so: what is THE capital, of", "what is the city", "yes yes", "eyes", "(\u6771\u4eac\u306f\u9996\u90fd)", "one two three four five six seven eight", "one two three four five six"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in dc.contaminated_passages(df, bench).orderBy("doc_id").collect()]
    assert got == [(0, 0, 1.0, 1, 4), (2, 1, 1.0, 0, 0), (4, 2, 1.0, 0, 0), (5, 3, 1.0, 0, 6), (6, 3, 12 / 14, 0, 5)]
    assert [r["doc_id"] for r in dc.decontaminated(df, bench).orderBy("doc_id").collect()] == [1, 3]


def test_edited_copies_of_short_items_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    items = [[f"i{n}{k}" for k in range(n)] for n in (5, 6, 7, 8, 9)] + [["x", "y", "x", "y", "x", "z"]]
    docs = []
    for _ in range(400):
        item = items[rng.integers(0, len(items))]
        copy = [x for w in item for x in ([] if rng.random() < 0.12 else ["zz" if rng.random() < 0.15 else w]) + (["yy"] if rng.random() < 0.12 else [])]
        docs.append([f"f{x}" for x in rng.integers(0, 50, 6)] + copy + [f"f{x}" for x in rng.integers(0, 50, 6)])
    want = {(i, k) for i, d in enumerate(docs) for k, item in enumerate(items) if aligned(item, d) >= max(len(item), 8)}
    assert len({i for i, _ in want}) > 100 and any(aligned(items[2], d) == 7 for d in docs)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in dc.contaminated_passages(df, bench).collect()} == want


# quality


def rated(rng, n):
    grades = rng.integers(0, 3, n)
    common = [f"word{i}" for i in range(300)]
    bad = [f"awful{i}" for i in range(8)]
    texts = []
    for g in grades:
        words = list(rng.choice(common, 60))
        words += list(rng.choice(bad, (4, 1, 0)[g])) if g < 2 else []
        texts.append(" ".join(w + ("***" if g == 0 else "") for w in words))
    return texts, grades


def test_ordinal_model_on_held_out_ratings():
    texts, grades = rated(np.random.default_rng(1), 1500)
    rows = [quality.features(t) for t in texts]
    model = quality.fit_ordinal(rows[:1000], grades[:1000], 3)
    assert model.thresholds[0] < model.thresholds[1]
    tails = model.tails(np.array([model.score(r) for r in rows[1000:]]))
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert (np.round(tails.sum(1)) == grades[1000:]).mean() > 0.9
    assert ((tails[:, 1] >= 0.5) == (grades[1000:] == 2)).mean() > 0.9


def test_gradient_free_check_of_the_likelihood():
    """Without features, the fitted thresholds give the grades' shares."""
    grades = np.repeat([0, 1, 2, 3], [10, 20, 30, 40])
    model = quality.fit_ordinal([np.empty(0, np.int64)] * 100, grades, 4)
    assert model.tails(np.zeros(1))[0] == pytest.approx([0.9, 0.7, 0.4], abs=0.01)


def test_repeated_ids_count_once_in_the_fit(spark):
    rows = [(i, f"word{i % 3} text {i}") for i in range(30)]
    ratings = spark.createDataFrame([(i, i % 3, "x") for i in range(30)], "doc_id long, grade int, text string")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.createDataFrame(rows + [(3, "word0 text 3")] * 400 + [(None, None)] * 3, "doc_id long, text string")
    one, two = (quality.fit(d, r, 3, fit_rows=20) for d, r in ((once, ratings), (often, ratings.union(ratings))))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.thresholds, two.thresholds)


def test_scores_and_selection(spark):
    texts, grades = rated(np.random.default_rng(2), 600)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1000, None, "x"), (1001, "", "x"), (None, texts[0], "x"), (5, texts[5], "x")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, g in enumerate(grades)] + [(None, 1, 0), (1000, None, 0), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.graded(labels), 3)
    out = quality.with_quality(docs, model).collect()
    assert len(out) == 604 and all(0 <= r["p_keep"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in out)
    chosen = quality.selected(docs, model)
    assert chosen.columns == docs.columns and chosen.count() == sum(r["kept"] for r in out)
    assert quality.fit(docs, quality.graded(labels.limit(0)), 3) is None
    assert quality.with_quality(docs, None).filter("kept").count() == 604 and quality.selected(docs, None).count() == 604
    assert quality.with_quality(docs.limit(0), model).count() == 0
