"""Token counts by heap-and-linked-list byte-pair merging, without producing ids.

The symbols of a pre-token form a doubly linked list; a heap holds its adjacent pairs by merge rank. The lowest
pair is popped and merged again and again; entries whose symbols have changed since are stale and skipped. The
count is the number of symbols at first minus the number of merges.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.tables import limit_batches, table
from pointweave.llm.token_ids import KEEP_LENGTH, SAFE_BELOW, Recent, byte_symbols, parted, vocabulary

VOCABULARY = "byte_bpe_50k.json"
MAX_TOKENS = 1024


def merged_length(symbols: str, ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols remain of a pre-token once every merge of the list has been made."""
    n = len(symbols)
    if n < 2:
        return n
    piece: list[str | None] = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if piece[i] != left or j >= n or piece[j] != right:
            continue
        merges += 1
        both = left + right
        piece[i], piece[j] = both, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get((both, piece[k]))
            if rank is not None:
                heappush(heap, (rank, i, both, piece[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((piece[h], both))
            if rank is not None:
                heappush(heap, (rank, h, piece[h], both))
    return n - merges


class TokenCounter:
    """Counts for a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = vocabulary(name)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        cut = Tokenizer.from_file(path).pre_tokenizer
        if type(cut).__name__ != "ByteLevel" or cut.add_prefix_space or not cut.use_regex:
            raise ValueError(f"{name}: a byte-level vocabulary with its usual pattern is needed")
        import public_tokenizers

        self.cut, self.split, self.symbols = cut.pre_tokenize_str, regex.compile(public_tokenizers.PATTERN).findall, dict(enumerate(byte_symbols()))
        self.chunks, self.words = Recent(250_000), Recent(150_000)

    def _word(self, symbols: str) -> int:
        if self.words.missing((symbols,)):
            self.words.young[symbols] = merged_length(symbols, self.ranks)
        n = self.words.young[symbols]
        if len(symbols) > 2 * KEEP_LENGTH:
            del self.words.young[symbols]
        self.words.settle()
        return n

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if max(text) < SAFE_BELOW:
            return sum([self._word(w.encode().decode("latin-1").translate(self.symbols)) for w in self.split(text)])
        return sum([self._word(symbols) for symbols, _ in self.cut(text)])

    def _chunk(self, chunk: str) -> int:
        """Special strings count as one token, as the library's default has it."""
        parts, found = [chunk], 0
        for s in self.special:
            if s in chunk:
                parts = [x for p in parts for x in p.split(s)]
        found = len(parts) - 1
        return found + sum(map(self._plain, parts))

    def count_all(self, texts: list[str | None]) -> list[int]:
        distinct, codes, starts, ends = parted(texts)
        new, known = self.chunks.missing(distinct), self.chunks.young
        for c in new:
            known[c] = self._chunk(c)
        sizes = np.array([known[c] for c in distinct], np.int64)
        self.chunks.forget_long(new)
        self.chunks.settle()
        bounds = np.concatenate([[0], np.cumsum(sizes[codes])])
        return (bounds[ends] - bounds[starts]).tolist()

    def count(self, text: str | None) -> int:
        return self.count_all([text])[0]


@functools.lru_cache(maxsize=2)
def counter(name: str) -> TokenCounter:
    return TokenCounter(name)


def with_token_counts(docs: DataFrame, max_tokens: int = MAX_TOKENS, vocabulary_name: str = VOCABULARY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: its key, n_bytes (UTF-8), n_tokens, over_limit (more than max_tokens).

    A null or empty text has no bytes and no tokens; a null key stays null; repeated rows stay repeated; other
    columns are not read. No shuffle: each task counts the texts of its split, whatever their length.
    """
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_all = counter(vocabulary_name).count_all
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count_all(batch.column(2).to_pylist()), pa.int64())], names=["k", "b", "n"])

    limit_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b"), F.col(text).alias("t"))
    return rows.mapInArrow(count, f"k {kind}, b long, n long").select(
        F.col("k").alias(key), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > max_tokens).alias("over_limit")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_token_counts(table(spark, sf_dir, "documents"))
