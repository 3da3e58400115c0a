"""Benchmark decontamination: rare seeds of word pairs, a count filter, then Smith-Waterman alignment; no step loses a copy.

A seed is a pair of neighbouring words of an item, found in a document as neighbours or with one word between. An
alignment of the wanted score holds at least a number of an item's seeds that follows from the scoring. If s of its
seeds are needed, leaving out its s - h most common ones still leaves h that every such alignment holds: only these
rare seeds join documents to items, rarity being counted over all documents. All seeds of the items that are found so
are counted then, stretches of a document with fewer than needed are left out, and a local alignment of the other
stretches' words scores them, so that copies with words replaced, dropped or put in are found too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.tables import limit_batches, small_side, table
from pointweave.llm.words import mix, ngram_hashes, plain_words, word_hashes
from pointweave.plans.scratch import staged

MATCH, MISMATCH, GAP = 2, -1, -1
#: Least alignment score as a share of an item's full score, 2 points a word.
SCORE = 0.5
#: Points that an alignment has at least, those of four words: half of a few words is no copy.
LEAST_POINTS = 4 * MATCH
#: Items with fewer words than this are searched for as a whole, word for word, which LEAST_POINTS asks of four words too.
LEAST_WORDS = 5
#: Rare seeds of an item that a document must hold, distinct ones, before the item's other seeds are looked for.
RARE_HITS = 2
#: Benchmark seeds that one pass over the documents looks for (about 40 bytes each in every task); more take more passes.
BROADCAST_SEEDS = 4_000_000
#: Words, or one text if it has more, whose seeds are looked up at once.
GROUP_WORDS = 1 << 16


def local_alignment(a: np.ndarray, b: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, int]:
    """Best Smith-Waterman score of word sequences a and b with a linear gap cost, and where it ends in b.

    Rows are computed at once: within a row, a gap's running cost turns the left neighbour into a running maximum.
    """
    if not len(a) or not len(b):
        return 0, 0
    best, end = 0, 0
    steps = np.arange(len(b) + 1) * -gap
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        up = row + gap
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(b == x, match, mismatch))
        up = np.maximum(up, 0)
        up[0] = 0
        row = np.maximum.accumulate(up + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def pair_hashes(hashes: np.ndarray, step: int = 1) -> np.ndarray:
    """A hash for each word and the one step words on."""
    return mix(mix(np.uint64(2) + hashes[:-step]) + hashes[step:])


def least_share(words: int, score: float = SCORE) -> float:
    """The share of its full score that an alignment with an item of so many words reaches at least."""
    return max(score, min(1.0, LEAST_POINTS / (MATCH * words)))


def needed_seeds(words: int, score: float = SCORE) -> int:
    """Seeds of an item that an alignment of the score holds at least.

    Matched words that follow one another without being a seed have two words or more put in between, which costs
    what the match gives, or the item skips a word there. With s seeds and b skips the score is at most
    2 s + b + 2, and the item has at least s + 2 b + 1 words.
    """
    return max(1, math.ceil((2 * score - 0.5) * words / 1.5 - 1 - 1e-9))


def item_seeds(items: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(item_id, words, seeds) of items with words: their hashes, and those of neighbours or, below least_words, of the whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, words, seeds = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                hashes = word_hashes(plain_words(text))
                if len(hashes):
                    keep.append(i)
                    words.append(hashes.astype(np.uint32).view(np.int32))
                    seeds.append((pair_hashes(hashes) if len(hashes) >= least_words else ngram_hashes(hashes, len(hashes))).view(np.int64))
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(words, ints), pa.array(seeds, longs)], names=["item_id", "words", "seeds"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null")
    return rows.mapInArrow(read, "item_id long, words array<int>, seeds array<long>").distinct()


def text_groups(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, hashes, starts): the word hashes of neighbouring texts, from number first on, and where each begins and ends."""
    first, words, starts = 0, [], [0]
    for i, text in enumerate(texts):
        words += plain_words(text)
        starts.append(len(words))
        if len(words) >= GROUP_WORDS:
            yield first, word_hashes(words), np.array(starts)
            first, words, starts = i + 1, [], [0]
    if len(starts) > 1:
        yield first, word_hashes(words), np.array(starts)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one run behind the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class SeedIndex:
    """The seeds of items in order, for each the items and places in which it is rare, and all seeds of an item."""

    def __init__(self, rows: pa.Table, score: float = SCORE, least_words: int = LEAST_WORDS):
        self.ids = rows["item_id"].to_numpy()
        lists = rows["words"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
        seeds = rows["seeds"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int64()))
        self.lengths = np.asarray(lists.value_lengths(), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.words = lists.flatten().to_numpy()
        self.shares = np.array([least_share(n, score) for n in self.lengths.tolist()])
        self.needed = np.array([needed_seeds(n, share) for n, share in zip(self.lengths.tolist(), self.shares.tolist())], np.int64)
        #: Words of a document that an alignment of the score spans at most.
        self.spans = np.ceil((3 - 2 * self.shares) * self.lengths).astype(np.int64)
        counts = np.asarray(seeds.value_lengths(), np.int64)
        flat = seeds.flatten().to_numpy()
        items = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        whole = np.repeat(self.lengths < least_words, counts)
        self.short = {}
        for n in np.unique(self.lengths[self.lengths < least_words]).tolist():
            at = np.flatnonzero(whole & (self.lengths[items] == n))
            self.short[n] = self._sorted(flat[at], items[at])
        counts = np.where(self.lengths < least_words, 0, counts)
        #: The seeds of an item in its order, as numbers of the distinct ones.
        self.own_starts = np.concatenate([[0], np.cumsum(counts)])
        self.pairs, own = np.unique(flat[~whole], return_inverse=True)
        self.own = own.astype(np.int32)
        #: Which low bits some seed has: most words' pairs are passed over without a search.
        self.sieve = np.zeros(1 << max(16, (8 * len(self.pairs)).bit_length()), bool)
        self.sieve[self.pairs & (len(self.sieve) - 1)] = True
        long = self.needed[self.lengths >= least_words]
        self.least = int(long.min()) if len(long) else 0
        self.hits = np.minimum(self.needed, RARE_HITS)

    def ranked(self, documents: np.ndarray) -> SeedIndex:
        """self, with the places in which a seed is one of its item's rare ones. documents: how many hold each distinct seed.

        Seeds rank by the work that they make, the documents that hold one times the items that have it.
        """
        sizes = np.diff(self.own_starts)
        items = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        ats = np.arange(len(items)) - np.repeat(self.own_starts[:-1], sizes)
        work = documents * np.bincount(self.own, minlength=len(self.pairs))
        order = np.lexsort((ats, work[self.own], items))
        kept = np.sort(order[ats < (sizes - self.needed + self.hits)[items]])  # items follow one another in order, as in ats
        kept = kept[np.argsort(self.own[kept], kind="stable")]
        self.rare_starts = np.concatenate([[0], np.cumsum(np.bincount(self.own[kept], minlength=len(self.pairs)))])
        self.rare_items = items[kept]
        return self

    @staticmethod
    def _sorted(seeds: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct seeds, where the items of each begin, and the items in the order of their seeds."""
        distinct, counts = np.unique(seeds, return_counts=True)
        return distinct, np.concatenate([[0], np.cumsum(counts)]), items[np.argsort(seeds, kind="stable")]

    @staticmethod
    def _find(known: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the grams that are known, and their places."""
        grams = grams.view(np.int64)
        at = np.searchsorted(known, grams)
        at[at == len(known)] = 0
        hit = np.flatnonzero(known[at] == grams)
        return at[hit], hit

    def exact(self, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, first word) of short items that are held as a whole, each at its first place."""
        for n, (known, offsets, items) in self.short.items():
            slots, places = self._find(known, ngram_hashes(hashes, n))
            slots, first = np.unique(slots, return_index=True)
            for slot, place in zip(slots.tolist(), places[first].tolist()):
                for item in items[offsets[slot] : offsets[slot + 1]].tolist():
                    yield item, place

    def seeds_of(self, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, slots, places) of the seeds that each of several texts holds, side by side or with one word between."""
        found, opened = [], mix(np.uint64(2) + hashes)
        for step in (1, 2):
            pairs = mix(opened[:-step] + hashes[step:]).view(np.int64)
            maybe = np.flatnonzero(self.sieve[pairs & (len(self.sieve) - 1)])
            slots, at = self._find(self.pairs, pairs[maybe])
            places = maybe[at]
            text = np.searchsorted(starts, places, "right") - 1
            inside = places + step < starts[text + 1]
            found.append((text[inside], slots[inside], (places - starts[text])[inside]))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def _with_rare_seeds(self, slots: np.ndarray) -> np.ndarray:
        """The items, in order, of which slots hold rare seeds enough."""
        slots = np.unique(slots)
        post = _runs(self.rare_starts[slots], self.rare_starts[slots + 1] - self.rare_starts[slots])
        who, rare = np.unique(self.rare_items[post], return_counts=True)
        return who[rare >= self.hits[who]]

    def stretches(self, slots: np.ndarray, places: np.ndarray, words: int) -> Iterator[tuple[int, int, int]]:
        """(item, first word, end) of a text's stretches with seeds enough, wide enough for any alignment around them.

        slots and places are the seeds that the text of so many words holds.
        """
        who = self._with_rare_seeds(slots)
        if not len(who):
            return
        order = np.argsort(slots, kind="stable")
        slots, places = slots[order], places[order]
        sizes = self.own_starts[who + 1] - self.own_starts[who]
        at = _runs(np.zeros(len(who), np.int64), sizes)
        own = self.own[_runs(self.own_starts[who], sizes)]
        first, times = np.searchsorted(slots, own), np.searchsorted(slots, own, "right")
        times = times - first
        item, at, place = np.repeat(np.repeat(who, sizes), times), np.repeat(at, times), places[_runs(first, times)]
        held = np.bincount(np.repeat(np.arange(len(who)), sizes), times > 0, len(who))
        who = who[held >= self.needed[who]]
        order = np.lexsort((place, item))
        item, place, at = item[order], place[order], at[order]
        for i, low, high in zip(who.tolist(), np.searchsorted(item, who).tolist(), np.searchsorted(item, who, "right").tolist()):
            p, a = place[low:high], at[low:high]
            span, needed = int(self.spans[i]), int(self.needed[i])
            ends = np.searchsorted(p, p + span, "right")
            starts = [int(p[k]) for k in np.flatnonzero(ends - np.arange(len(p)) >= needed).tolist() if len(np.unique(a[k : ends[k]])) >= needed]
            low = 0
            for k in range(1, len(starts) + 1):
                if k == len(starts) or starts[k] - starts[k - 1] > 2 * span:
                    yield i, max(starts[low] - span, 0), min(starts[k - 1] + span + 3, words)
                    low = k


    def alignments(self, hashes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, last word) of what aligns in each of several texts."""
        for text in range(len(starts) - 1) if self.short else ():
            for item, at in self.exact(hashes[starts[text] : starts[text + 1]]):
                yield text, item, 1.0, at, at + int(self.lengths[item]) - 1
        if not len(self.pairs):
            return
        texts, slots, places = self.seeds_of(hashes, starts)
        order = np.argsort(texts, kind="stable")
        slots, places = slots[order], places[order]
        ends = np.cumsum(np.bincount(texts, minlength=len(starts) - 1))
        words = hashes.astype(np.uint32).view(np.int32)
        for text in np.flatnonzero(np.diff(ends, prepend=0) >= max(self.least, 1)).tolist():
            own = words[starts[text] : starts[text + 1]]
            held = slice(int(ends[text - 1]) if text else 0, int(ends[text]))
            for item, first, last in self.stretches(slots[held], places[held], len(own)):
                a, b = self.words[self.starts[item] : self.starts[item + 1]], own[first:last]
                best, stop = local_alignment(a, b)
                share = best / (MATCH * len(a))
                if share >= self.shares[item]:
                    _, length = local_alignment(a[::-1], b[:stop][::-1])
                    yield text, item, share, first + stop - length, first + stop - 1


def _passages(docs: DataFrame, index: SeedIndex) -> DataFrame:
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, items, points, start, end = [], [], [], [], []
            for first, hashes, starts in text_groups(batch.column(1).to_pylist()):
                for text, item, share, low, high in index.alignments(hashes, starts):
                    keep.append(first + text)
                    items.append(int(index.ids[item]))
                    points.append(share)
                    start.append(low)
                    end.append(high)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(items, pa.int64()), pa.array(points, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=["doc_id", "item_id", "score", "first_word", "last_word"],
            )

    limit_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    return rows.mapInArrow(align, "doc_id long, item_id long, score double, first_word long, last_word long")


def document_counts(docs: DataFrame, index: SeedIndex) -> np.ndarray:
    """How many documents hold each seed of the index, over all of docs; a task passes on one row a seed that it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(index.pairs), np.int64)
        for batch in batches:
            for _, hashes, starts in text_groups(batch.column(0).to_pylist()):
                texts, slots, _ = index.seeds_of(hashes, starts)
                np.add.at(found, np.unique(texts << 32 | slots) & 0xFFFFFFFF, 1)
        met = np.flatnonzero(found)
        for at in range(0, len(met), 1 << 16):
            part = met[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(found[part], pa.int64())], names=["slot", "n"])

    out = np.zeros(len(index.pairs), np.int64)
    if len(out):
        limit_batches(docs.sparkSession)
        counted = docs.select("text").filter("text is not null").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        out[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    return out


def seed_hits(docs: DataFrame, seeds: DataFrame, score: float = SCORE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of every stretch with seeds enough that aligns.

    Documents are read twice, to count seeds and to find them. With more seeds than one pass looks for, items are dealt
    to several passes, each written before the next.
    """
    count, items = seeds.agg(F.sum(F.size("seeds")), F.count("*")).first()
    passes = max(1, min(items, math.ceil((count or 0) / max(broadcast_seeds, 1))))
    out = None
    for k in range(passes):
        part = seeds.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(passes)) == k) if passes > 1 else seeds
        index = SeedIndex(part.toArrow(), score)
        found = _passages(docs, index.ranked(document_counts(docs, index)))
        found = staged(found, "passages") if passes > 1 else found
        out = found if out is None else out.union(found)
    return out


def contaminated_passages(docs: DataFrame, items: DataFrame, score: float = SCORE) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): documents that hold a passage aligned with a benchmark item.

    score is the alignment's share of the item's full score, 1 for a copy; the words (from 0) bound the best passage.
    Every alignment of the score, for scores of 0.35 or more, is found that is worth LEAST_POINTS too, so an item of five
    to seven words needs more than half. Items of fewer than LEAST_WORDS words are found where they stand word for word; a
    single word counts, as scripts without blanks give one word a run. Words
    are runs of letters, digits and non-ASCII characters with A-Z in lower case. Null and empty texts hold nothing; rows whose doc_id is null are
    searched and returned as such; repeated rows give one row an item; items with a null id or without words are not
    searched for; other columns are not read. Empty tables give no rows.
    """
    scored = seed_hits(docs, staged(item_seeds(items), "seeds"), score)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("early"), "last_word")).alias("best")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", (-F.col("best.early")).alias("first_word"), "best.last_word")


def decontaminated(docs: DataFrame, items: DataFrame, score: float = SCORE) -> DataFrame:
    """docs without the documents that hold a benchmark passage; rows with a null id go only if a null-id row holds one."""
    found = staged(contaminated_passages(docs, items, score).select("doc_id").distinct(), "leaks")
    named = docs.join(small_side(found), "doc_id", "left_anti").select(docs.columns)
    if found.filter("doc_id is null").limit(1).count():
        return named.filter("doc_id is not null")
    return named


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
