import random

import numpy as np
import pytest

from pointweave.llm import decontamination as dc
from pointweave.llm import near_vectors as nv
from pointweave.llm import pipeline, quality, url_filter
from test_near_duplicates import brute_force
from test_tokens import check_packing, ids, library  # noqa: F401

GOOD, BAD = "the river runs past quiet fields where people grow wheat and barley in spring", "click buy cheap pills win prize free bonus cash casino spam offer deal"


def text_of(rng, source, n):
    return " ".join(rng.choice(source.split()) + rng.choice(["", "", "s"]) for _ in range(n))


def alignment(a, b):
    """Smith-Waterman cell by cell."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (dc.MATCH if x == y else dc.MISMATCH), row[j] + dc.GAP, new[-1] + dc.GAP))
        best, row = max(best, max(new)), new
    return best


def leaks(text, items):
    words = dc.plain_words(text)
    for item in items:
        own = dc.plain_words(item)
        if len(own) < dc.LEAST_WORDS:
            if any(words[k : k + len(own)] == own for k in range(len(words))):
                return True
        elif alignment(own, words) >= max(dc.SCORE * dc.MATCH * len(own), dc.LEAST_POINTS):
            return True
    return False


def test_stages_equal_a_chain_of_brute_force(spark, tmp_path, library):  # noqa: F811
    rng = random.Random(7)
    items = [f"question {k} asks how many " + text_of(rng, GOOD, 14) + f" are left by {k}" for k in range(3)] + ["only four words here"]
    rows = [(i, text_of(rng, GOOD if i % 3 else BAD, rng.randrange(20, 60))) for i in range(90)]
    rows += [(100 + i, rows[1 + 3 * i][1]) for i in range(5)]  # exact copies
    rows += [(110 + i, rows[2 + 3 * i][1] + " again") for i in range(5)]  # near copies
    rows += [(120 + i, text_of(rng, GOOD, 10) + " " + " ".join(w for w in item.split() if rng.random() < 0.9) + " " + text_of(rng, GOOD, 10)) for i, item in enumerate(items[:3])]
    rows += [(130, text_of(rng, GOOD, 12) + " Only four words here, " + text_of(rng, GOOD, 12)), (131, None), (132, ""), (131, None), (133, text_of(rng, GOOD, 4000))]
    docs = [(i, t, "en", 1) for i, t in rows]
    labels = [(i, int(i % 3 > 0), 0) for i, _ in rows[:90]] + [(None, 1, 1), (500, None, 0)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, component string, n_tokens int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got, current = [], spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fitted(spark, current, folder)
    for _, stage in pipeline.STAGES:
        current = pipeline.staged(stage(spark, current, folder), "stage")
        got.append([r.asDict() for r in current.collect()])
    pairs = lambda found: sorted(((r["doc_id"], r["text"]) for r in found), key=repr)
    kept = [(i, t) for i, t in rows if model.tails(np.array([model.score(quality.features(t))]))[0, quality.KEEP_GRADE - 1] >= quality.KEEP_PROBABILITY]
    assert pairs(got[0]) == sorted(kept, key=repr) and {i for i, _ in rows[:90] if i % 3} <= {i for i, _ in kept} and not {i for i, _ in rows[:90] if not i % 3} & {i for i, _ in kept}
    stays = {r[0] for r in brute_force(kept) if r[3]}
    kept = list({i: (i, t) for i, t in kept if i in stays}.values())
    assert pairs(got[1]) == sorted(kept, key=repr)
    kept = [(i, t) for i, t in kept if not leaks(t, items)]
    assert pairs(got[2]) == sorted(kept, key=repr) and not {120, 121, 122, 130} & {i for i, _ in kept}
    assert set(got[2][0]) == {"doc_id", "text", "component", "n_tokens"}
    check_packing(got[3], dict(kept), library, 2048)


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    folder = str(tmp_path)
    for name, kinds in (("documents", "doc_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kinds).write.parquet(f"{folder}/{name}.parquet")
    assert pipeline.run(spark, folder).count() == 0


def test_ordinal_fit_is_a_stationary_point():
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(6) < 0.5).astype(np.int32) for _ in range(300)]
    grades = np.array([int(np.clip(round(r.sum() / 6 + rng.normal()), 0, 2)) for r in rows])
    model = quality.fit_ordinal(rows, grades, 3, l2=0.05, steps=4000, least_share=0, least_z=0)
    dense = np.array([[b in set(r.tolist()) for b in model.buckets] for r in rows], float)

    def loss(p):
        tail = 1 / (1 + np.exp(np.array(p[-2:])[None, :] - (dense @ p[:-2])[:, None]))
        chance = np.column_stack([1 - tail[:, 0], tail[:, 0] - tail[:, 1], tail[:, 1]])[np.arange(len(rows)), grades]
        return -np.log(chance).mean() + 0.025 * (p[:-2] ** 2).sum()

    at = np.concatenate([model.weights, model.thresholds])
    slope = [(loss(at + 1e-5 * e) - loss(at - 1e-5 * e)) / 2e-5 for e in np.eye(len(at))]
    assert np.abs(slope).max() < 2e-3 and model.thresholds[0] < model.thresholds[1]


def test_segmentation_equals_the_best_of_all_splits():
    rng = random.Random(2)
    for _ in range(200):
        name = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
        known = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 50) for _ in range(5)}
        total = sum(known.values())
        value = lambda w: np.log(known[w] / total) if w in known else np.log(10 / total) - len(w) * np.log(10)  # noqa: B023,E731
        splits = []
        for mask in range(1 << (len(name) - 1)):
            cuts = [0, *[i + 1 for i in range(len(name) - 1) if mask >> i & 1], len(name)]
            splits.append([name[a:b] for a, b in zip(cuts, cuts[1:])])
        parts = [(a, b - a, known[name[a:b]]) for a in range(len(name)) for b in range(a + 1, len(name) + 1) if name[a:b] in known]
        got = url_filter.split_name(name, parts, total)
        assert "".join(got) == name
        assert sum(map(value, got)) == pytest.approx(max(sum(map(value, s)) for s in splits), abs=1e-9)


def test_words_and_names_of_any_length(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    words = spark.createDataFrame([(long, 3000), ("clinic", 5000), ("x", 1)], "word string, n long")
    names = spark.createDataFrame([(long + "clinic",), ("z" * 40 + "clinic",)], "name string")
    found = {r["name"]: r["words"] for r in url_filter.name_segments(names, words).collect()}
    assert found == {long + "clinic": [long, "clinic"], "z" * 40 + "clinic": ["z" * 40, "clinic"]}


def test_many_equal_vectors_cost_no_pairs(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(20_000)] + [(30_000, [1.0, 2.0, 3.0, 4.01]), (30_001, [-1.0, 2.0, -3.0, 4.0]), (30_002, [1e200, 2e200, 3e200, 4e200])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nv.near_vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (20_001, 0) for i in [*range(20_000), 30_000, 30_002]} | {30_001: (0, 30_001)}
