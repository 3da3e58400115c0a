import random

import numpy as np
import pandas as pd
import pytest

from pointweave.llm import near_duplicates as nd
from pointweave.llm import near_vectors as nv

SCHEMA = "doc_id long, text string, n_shingles string, id string"


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    return [w for w in lowered.split(" ") if w]


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows):
    """The contract by definition: {doc_id: (sizes, component)}."""
    sets = [(i, set_of(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    out = sorted((i, len(s), root(i), root(i) == i) for i, s in sets)
    return out + [(None, len(set_of(t)), None, True) for i, t in rows if i is None]


def edited(rng, words, share):
    return [rng.choice("abcdefgh") + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def make_rows():
    rng = random.Random(5)
    rows, bases = [], [[f"w{rng.randrange(400)}" for _ in range(n)] for n in (30, 60, 120, 300, 40)]
    for k in range(260):
        rows.append((1000 - k, " ".join(edited(rng, bases[k % 5], rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05])))))
    rows += [(5, None), (6, ""), (7, "  \n "), (8, "one two"), (9, "ONE\ttwo"), (9, "One two"), (10, "één twee"), (11, "One two three"), (12, "x " * 4000), (13, "x " * 5000), (None, "one two"), (None, None)]
    rows += [(3000 + i, " ".join(bases[0])) for i in range(40)] + [(9, "other words altogether that stand here"), (14, "other words altogether that stand here")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def test_components_equal_brute_force(spark):
    rows = make_rows()
    got = sorted((tuple(r) for r in nd.near_duplicate_components(frame(spark, rows)).collect()), key=key)
    assert got == sorted(brute_force(rows), key=key)
    kept = nd.deduplicated(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "n_shingles", "id"]
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and sorted(x for x in ids if x is not None) == sorted({r[0] for r in brute_force(rows) if r[3] and r[0] is not None})


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "SMALL_BUCKET", 3)
    monkeypatch.setattr(nd, "BLOCK", 8)
    rows = make_rows()[:150]
    got = sorted(tuple(r) for r in nd.near_duplicate_components(frame(spark, rows)).collect())
    assert got == brute_force(rows)


def test_empty_tables(spark):
    assert nd.near_duplicate_components(frame(spark, [])).count() == 0
    assert nd.deduplicated(frame(spark, [])).count() == 0
    assert nv.near_vector_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.3, 0.75, 1.0):
        both, n = int(3000 * share), 3000
        common = rng.integers(0, 2**63, both, np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, (n - both) // 2, np.uint64)]) for _ in range(2))
        low = [nd.packed(nd.minima(x))[None, :] for x in (a, b)]
        jaccard = both / (both + 2 * ((n - both) // 2))
        assert abs(nd.estimated_similarity(int(nd.equal_low_bits(*low)[0, 0])) - jaccard) < 0.13
    assert nd.estimated_similarity(nd.MINIMA) == 1.0


def vectors():
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        rows += [(len(rows) + i, (centre + rng.standard_normal(16) * rng.choice([0.01, 0.1, 0.2, 0.4])).tolist()) for i in range(10)]
    hot = rng.standard_normal(16)
    rows += [(1000 + i, (hot + 0.01 * rng.standard_normal(16)).tolist()) for i in range(150)]
    rows += [(2000, rows[0][1]), (2001, None), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [float("inf")] * 16)]
    rows += [(None, rows[0][1]), rows[3]]
    return rows


@pytest.mark.parametrize("block, chunk", [(nv.BLOCK, nv.CHUNK), (64, 24)])
def test_vectors_against_every_pair(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(nv, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links string")
    got = nv.near_vector_components(df).collect()
    assert len(got) == len(rows)
    sound = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    links = {i: {j for j, w in sound.items() if j != i and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.9} for i, v in sound.items()}
    found, all_links = 0, sum(map(len, links.values()))
    for r in got:
        found += r["n_links"] if r["vec_id"] != rows[3][0] else r["n_links"] / 2
        assert r["n_links"] <= len(links.get(r["vec_id"], ()))
        assert r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"])
        if r["vec_id"] in (2001, 2002, 2003, 2004, 2005, 2008, None):
            assert r["n_links"] == 0 and r["component_id"] == r["vec_id"]
    assert found >= 0.97 * all_links
    assert {r["component_id"] for r in got if (r["vec_id"] or 0) // 1000 == 1} == {1000}


def test_chunks_of_a_block_find_the_same_links(monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((90, 8)) * 0.3 + np.repeat(rng.standard_normal((9, 8)), 10, axis=0)
    lists = [np.array(sorted({0, *rng.choice(12, 4)}), np.int32) for _ in v]
    block = pd.DataFrame({"length": 8, "list": 0, "bi": 0, "bj": 0, "side": 0, "row_id": rng.permutation(90), "place": [0.0] * 90, "v": list(v), "copies": rng.integers(1, 4, 90), "lists": lists, "places": [np.zeros(len(x), np.float32) for x in lists]})
    results = []
    for chunk, held in ((256, 4 << 20), (7, 64 * 8)):
        monkeypatch.setattr(nv, "CHUNK", chunk)
        monkeypatch.setattr(nv, "VERIFIED_BYTES", held)
        results.append(nv._meet(0.9, {8: (6, 0.0, 1.0)}, 2)(block))
    assert results[0].equals(results[1])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids, copies = block["row_id"], block["copies"]
    links = {i: {j for j in range(90) if i != j and len(set(lists[i]) & set(lists[j])) > 1 and unit[i] @ unit[j] >= 0.9} for i in range(90)}
    assert dict(zip(results[0]["row_id"], results[0]["links"])) == {ids[i]: sum(copies[j] for j in js) for i, js in links.items() if js}
    reached = dict(zip(results[0]["row_id"], results[0]["reached"]))
    assert all(reached[ids[i]] == reached[ids[j]] for i, js in links.items() for j in js)


def test_calibration_reaches_the_recall():
    rng = np.random.default_rng(4)
    n, d = 2000, 64
    directions, bound, window = nv.calibrate(n, d)
    x = rng.standard_normal((400, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((400, d))
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    p = nv._directions(directions, d).T
    a, b = x @ p, y @ p
    shared = ((np.minimum(np.abs(a), np.abs(b)) >= bound) & (a * b > 0) & (np.abs(a - b) <= window)).sum(1)
    assert (shared >= nv.COLLISIONS).mean() >= 0.98


def test_recall_in_large_tables_and_few_dimensions():
    rng = np.random.default_rng(6)
    for n, d in ((1_000_000, 64), (5_000_000, 64), (1_000_000, 16), (80_000, 4)):
        directions, bound, window = nv.calibrate(n, d)
        x = rng.standard_normal((500, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((500, d))
        y -= (x * y).sum(1, keepdims=True) * x
        y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
        shared = np.zeros(500, int)
        for p in np.array_split(nv._directions(directions, d), 20):
            a, b = x @ p.T, y @ p.T
            shared += ((np.minimum(np.abs(a), np.abs(b)) >= bound) & (a * b > 0) & (np.abs(a - b) <= window)).sum(1)
        assert (shared >= nv.COLLISIONS).mean() >= 0.98, (n, d)


def test_equal_vectors_of_few_dimensions_link(spark):
    rows = [(10 * d + i, [(-1.0) ** k * (i + 1) for k in range(d)]) for d in (1, 2, 4) for i in range(3)]
    got = nv.near_vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (2, i - i % 10) for i, _ in rows}


def test_any_number_of_lengths(spark):
    rows = [(2 * d + i, [1.0] * d) for d in range(1, 1031) for i in (0, 1)]
    got = nv.near_vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert got.filter("n_links = 1 and component_id = vec_id - vec_id % 2").count() == len(rows)
