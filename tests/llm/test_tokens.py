import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pointweave.llm import packing, token_counts, token_files
from pointweave.llm.token_ids import IdEncoder, vocabulary
from pointweave.plans.scratch import scratch_path

NAME = "byte_bpe_50k.json"
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b\n", "\n\n x", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>z", "it's we'll I'M 12 345abc é ñandú",
    "über   x  y \x1c z", "日本語 テスト", "a" * 5000, "ab" * 3000 + " " + "x1" * 2000, "՘ ֋\U00010940 x", "word " * 3000, "🙂🙂 🙂",
]
ALPHABET = "abT1'sé \n\t  .,.,\0\x1c<|>ß日!-_²\xa0\x85"
ROWS = [(i, t, "en", "extra") for i, t in enumerate(TEXTS)] + [(3, "  ", "en", "extra"), (None, "no id", None, None)]
SCHEMA = "doc_id long, text string, n_tokens string, sequence_id string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(NAME))


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.sampled_from(ALPHABET), max_size=40) | st.text(st.sampled_from(ALPHABET) | st.characters(codec="utf-8"), max_size=40) | st.sampled_from([t for t in TEXTS if t]))
def test_chunked_ids_and_merge_counts_equal_the_library(library, text):
    expected = ids(library, text)
    assert np.frombuffer(IDS.encode(text), "<u4").tolist() == expected
    assert COUNTS.count(text) == len(expected)


IDS, COUNTS = IdEncoder(NAME), token_counts.TokenCounter(NAME)


def test_counts_of_whole_texts(spark, library):
    rows = token_counts.with_token_counts(spark.createDataFrame(ROWS, SCHEMA), max_tokens=100).collect()
    expected = [(i, len((t or "").encode()), n := len(ids(library, t)), n > 100) for i, t, *_ in ROWS]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)
    assert token_counts.with_token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merges_follow_the_rank_order():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("ab", "c"): 2}
    assert token_counts.merged_length("abc", ranks) == 2  # b c first, then nothing joins a and bc
    assert token_counts.merged_length("aaaa", {("a", "a"): 0, ("aa", "aa"): 1}) == 1
    assert token_counts.merged_length("aaa", {("a", "a"): 0}) == 2
    assert token_counts.merged_length("x", {}) == 1


def check_packing(rows, docs, library, tokens, most_documents=None, most_cost=None):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in docs.items():
        own, all_ids = sorted(by_doc.pop(i), key=lambda r: r["piece"]), ids(library, text) + [0]
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(all_ids) // tokens)
        assert all(r["length"] == tokens for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(np.array(all_ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(all_ids)
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= tokens
        assert most_documents is None or len(own) <= most_documents
        assert most_cost is None or sum(packing.attention_cost(r["length"]) for r in own) <= most_cost


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_id_in_place(spark, library, rule):
    docs = {i: t for i, t, *_ in ROWS[: len(TEXTS)]}
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs.items()], SCHEMA)
    for capacity in (packing.Capacity(64), packing.Capacity(64, documents=2), packing.Capacity(64, cost=2080)):
        check_packing(packing.packed_sequences(df, capacity, rule).collect(), docs, library, capacity.tokens, capacity.documents, capacity.cost)
    assert packing.packed_sequences(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(None, None, "", ""), (None, None, "", ""), (1, "a b", "", "")], SCHEMA)
    assert sorted(r["offset"] for r in packing.packed_sequences(odd).collect()) == [0, 3, 4]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=20), st.sampled_from(["norm", "dot"]), st.integers(3, 50), st.integers(1300, 3000))
def test_plans_hold_every_constraint(histogram, rule, documents, cost):
    capacity = packing.Capacity(50, documents, cost)
    bins, intervals = packing.plan_packing(histogram, capacity, rule)
    placed = {}
    for held, count in bins:
        assert sum(held) <= 50 and len(held) <= documents and sum(map(packing.attention_cost, held)) <= cost
        for n in held:
            placed[n] = placed.get(n, 0) + count
    assert placed == histogram
    for n, c in histogram.items():
        ends = sorted((first, first + count) for length, first, count, *_ in intervals if length == n)
        assert ends[0][0] == 0 and ends[-1][1] == c and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_plan_is_close_to_the_least_number_of_bins():
    rng = np.random.default_rng(3)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(rng.integers(1, 900, 20000), return_counts=True))))
    bins, _ = packing.plan_packing(histogram, packing.Capacity(2048))
    least = -(-sum(n * c for n, c in histogram.items()) // 2048)
    assert sum(c for _, c in bins) <= 1.005 * least + 1
    with pytest.raises(ValueError):
        packing.plan_packing({60: 1}, packing.Capacity(50))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_come_back_in_order(spark, library, encoding):
    import pyarrow.parquet as pq

    path = scratch_path(spark, "t")
    token_files.write_token_files(spark.createDataFrame(ROWS, SCHEMA), path, encoding)
    files = token_files.read_token_files(spark, path)
    rows = token_files.token_file_digests(files).collect()
    expected, start = [], 0
    for i, t, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        all_ids = ids(library, t) + [0]
        expected.append((i, start, len(all_ids), zlib.crc32(np.array(all_ids, "<u4").tobytes())))
        start += len(all_ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected
    assert files.filter("doc_id = 12").select("ids").first()[0] == ids(library, TEXTS[12]) + [0]
    name = next(f for f in spark.read.parquet(path).inputFiles())
    column = [pq.ParquetFile(name.removeprefix("file:")).metadata.row_group(0).column(i) for i in range(4)]
    assert all(c.has_column_index and c.has_offset_index for c in column[:3])
    assert any(("DELTA_BINARY_PACKED" if encoding == "delta" else "DICTIONARY") in e for e in column[3].encodings)
    empty = scratch_path(spark, "t")
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), empty, encoding)
    assert token_files.token_file_digests(token_files.read_token_files(spark, empty)).count() == 0
