"""Audit of how far the sources of a language differ, by an exact recount in perfect-hash slots.

The first pass counts in how many documents of its language a term occurs; the frequent ones are kept. Kept terms are
cut into shards, and every shard gets a minimal perfect hash (levels of bit arrays, as in Limasset et al. 2017) and its
terms in the order of the slots. The second pass has shards of a bounded size broadcast, looks the terms of a batch up,
verifies them against the stored ones, and increments dense slots of each language and source; as many passes follow as
the shards need. Smoothed shares and their distances are integers throughout.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.tables import limit_batches, table
from pointweave.llm.words import letter_words, mix, word_hashes
from pointweave.plans.scratch import staged

LEAST_DOCUMENTS, BEST_TERMS = 10, 10
#: Terms of a shard on average, and bytes of the shards of one pass.
SHARD_TERMS, PASS_BYTES = 1 << 15, 64 << 20
#: Entries that a task counts before it passes them on, and bytes of dense slots.
ENTRIES, SLOT_BYTES = 200_000, 64 << 20
#: Slots and sources of a tile of the comparison of sources.
TILE_SLOTS, TILE_SOURCES = 4096, 128
#: Bits of a level for each term that it is offered, and levels after which the few left are listed.
SPACE, LEVELS = 2, 40


class PerfectHash:
    """Slots 0 to n - 1 of n terms, one each: a term's slot is the rank of its bit in the first level where it stands alone."""

    def __init__(self, sizes: list[int], bits: np.ndarray, terms: pa.Array):
        self.sizes, self.terms = sizes, terms
        self.bits = bits.astype(bool)
        self.ranks = np.cumsum(self.bits) - 1
        self.placed = int(self.bits.sum())
        self.listed = {t: self.placed + i for i, t in enumerate(terms[self.placed :].to_pylist())}

    @staticmethod
    def place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, terms: list[bytes], levels: int = LEVELS) -> PerfectHash:
        hashes, left = word_hashes(terms), np.arange(len(terms))
        sizes, bits, order = [], [], []
        while len(left) and len(sizes) < levels:
            size = SPACE * len(left)
            at = cls.place(hashes[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            mine = alone[at]
            order.append(left[mine][np.argsort(at[mine])])
            sizes.append(size)
            bits.append(alone)
            left = left[~mine]
        slots = np.concatenate([*order, left]).astype(np.int64)
        return cls(sizes, np.concatenate([*bits, np.zeros(0, bool)]), pa.array([terms[i] for i in slots], pa.binary()))

    def slots(self, terms: list[bytes]) -> np.ndarray:
        """The slot of each term, -1 for one that the shard does not hold: the stored term decides."""
        hashes, found = word_hashes(terms), np.full(len(terms), -1, np.int64)
        left, offset = np.arange(len(terms)), 0
        for level, size in enumerate(self.sizes):
            at = offset + self.place(hashes[left], level, size)
            hit = self.bits[at]
            found[left[hit]] = self.ranks[at[hit]]
            left, offset = left[~hit], offset + size
        for i in left.tolist() if self.listed else ():
            found[i] = self.listed.get(terms[i], -1)
        tried = np.flatnonzero(found >= 0)
        stored = self.terms.take(pa.array(found[tried]))
        same = pc.equal(stored, pa.array([terms[i] for i in tried], pa.binary())).to_numpy(zero_copy_only=False).astype(bool)
        found[tried[~same]] = -1
        return found


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term binary, n): documents of the language that hold the term; counted in tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            columns = [[lang for lang, c in seen.items() for _ in c], [t for c in seen.values() for t in c], [n for c in seen.values() for n in c.values()]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], names=["lang", "term", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(set(letter_words(text)))
            if sum(map(len, seen.values())) > ENTRIES:
                yield rows()
                seen.clear()
        yield rows()

    return docs.select("lang", "text").mapInArrow(count, "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def shards_of(kept: DataFrame, sizes: DataFrame, terms_a_shard: int) -> DataFrame:
    """(lang, shard, shards, n, bytes, sizes, bits, terms): perfect hashes of the kept terms, built a shard a group."""

    def build(group: pa.Table) -> pa.Table:
        made = PerfectHash.build(group.column("term").to_pylist())
        row = {
            "lang": [group.column("lang")[0].as_py()], "shard": [group.column("shard")[0].as_py()], "shards": [group.column("shards")[0].as_py()], "n": [len(made.terms)], "bytes": [made.terms.nbytes + 10 * len(made.bits)],
            "sizes": [made.sizes], "bits": [np.packbits(made.bits).tobytes()], "terms": [made.terms.to_pylist()],
        }
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(row.items(), kinds)})

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
    shards = F.ceil(F.col("kept") / terms_a_shard).cast("long")
    dealt = kept.join(sizes, "lang").withColumn("shards", shards).withColumn("shard", F.crc32("term") % F.col("shards"))
    return dealt.select("lang", "shard", "shards", "term").groupBy("lang", "shard").applyInArrow(build, "lang string, shard long, shards long, n long, bytes long, sizes array<long>, bits binary, terms array<binary>")


def recounted(docs: DataFrame, shards: list) -> DataFrame:
    """(lang, source, shard, slot, n): occurrences of the terms of these shards by language and source; those with any.

    shards are collected rows of shards_of, of bounded bytes.
    """
    spark = docs.sparkSession
    given = [(r["lang"], r["shard"], r["shards"], list(r["sizes"]), bytes(r["bits"]), [bytes(t) for t in r["terms"]]) for r in shards]
    sent = spark.sparkContext.broadcast(given)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, dict[int, PerfectHash]] = {}
        parts: dict[str, int] = {}
        for lang, shard, of, sizes, bits, terms in sent.value:
            unpacked = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes))
            hashes.setdefault(lang, {})[shard] = PerfectHash(sizes, unpacked, pa.array(terms, pa.binary()))
            parts[lang] = of
        dense: dict[tuple[str, str, int], np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            slots = [np.flatnonzero(d) for d in dense.values()]
            columns = [[k[i] for k in dense] for i in range(3)]
            lists = [pa.array(s.tolist(), pa.int64()) for s in slots], [pa.array(d[s].tolist(), pa.int64()) for s, d in zip(slots, dense.values())]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), *[pa.array([x.to_pylist() for x in part], pa.list_(pa.int64())) for part in lists]], names=["lang", "source", "shard", "slots", "counts"]
            )

        for batch in batches:
            groups: dict[str, dict[str, Counter]] = {}
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                if lang in hashes:
                    groups.setdefault(lang, {}).setdefault(source, Counter()).update(letter_words(text))
            for lang, sources in groups.items():
                by_shard: dict[int, list[bytes]] = {}
                for term in set().union(*sources.values()):
                    by_shard.setdefault(zlib.crc32(term) % parts[lang], []).append(term)
                for shard, held in hashes[lang].items():
                    terms = by_shard.get(shard, [])
                    slot = {t: s for t, s in zip(terms, held.slots(terms).tolist()) if s >= 0}
                    for source, counter in sources.items():
                        hit = slot.keys() & counter.keys()
                        if hit:
                            own = dense.get((lang, source, shard))
                            if own is None:
                                own = dense[lang, source, shard] = np.zeros(len(held.terms), np.int64)
                            own[[slot[t] for t in hit]] += [counter[t] for t in hit]  # slots of different terms differ
            if sum(d.nbytes for d in dense.values()) > SLOT_BYTES:
                yield rows()
                dense.clear()
        yield rows()

    found = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, shard long, slots array<long>, counts array<long>")
    each = found.select("lang", "source", "shard", F.explode(F.arrays_zip("slots", "counts")).alias("e"))
    return each.groupBy("lang", "source", "shard", F.col("e.slots").alias("slot")).agg(F.sum("e.counts").alias("n"))


def share(count, total, kept):
    """1 + floor(10 ** 9 * (count + 2) / (total + 2 * kept)), in decimals that hold every product."""
    wide = lambda c: c.cast("decimal(19,0)")
    space = wide(total) + 2 * kept
    product = F.lit(1_000_000_000).cast("decimal(10,0)") * (wide(count) + 2)
    return F.call_function("div", product, space).cast("long") + 1


def distance(p, q):
    """floor((p - q) ** 2 / (p + q)), of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same as share() on arrays, three decimal digits at a time, so that no product leaves 64 bits below 9 * 10 ** 15 occurrences."""
    rest, out = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // totals, rest % totals
    return out + 1


def _tiled(tile_slots: int, tile_sources: int):
    def tile(key, entries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        """Sums of distances over a tile's slots for its pairs of sources, each pair once."""
        groups = groups.sort_values("number")
        numbers, block = groups["number"].to_numpy(), (groups["number"] // tile_sources).to_numpy()
        counts = np.zeros((int(groups["n_slots"].iloc[0]), len(groups)), np.int64)
        counts[entries["slot"].to_numpy() % tile_slots, np.searchsorted(numbers, entries["number"].to_numpy())] = entries["n"].to_numpy()
        shares = _shares(counts, (groups["total"] + 2 * groups["kept"]).to_numpy()[None, :]) if len(counts) else counts
        out = [pd.DataFrame({"lang": "", "a": numbers[:0], "b": numbers[:0], "value": numbers[:0]})]
        for i in np.flatnonzero(block == int(key[3])).tolist():
            later = np.flatnonzero((block == int(key[4])) & (numbers > numbers[i]))
            gap = shares[:, later] - shares[:, i : i + 1]
            sums = (gap * gap // (shares[:, later] + shares[:, i : i + 1])).sum(axis=0)
            out.append(pd.DataFrame({"lang": key[0], "a": numbers[i], "b": numbers[later], "value": sums}))
        return pd.concat(out)

    return tile


def source_pairs(counts: DataFrame, groups: DataFrame, shards: DataFrame) -> DataFrame:
    """(lang, a, b, value): the summed distance of two sources (numbers, a < b) over all kept terms of their language.

    A tile is a stretch of slots and two stretches of sources; terms that neither source has count too.
    """
    parts = groups.groupBy("lang").agg((F.floor(F.max("number") / TILE_SOURCES) + 1).alias("parts"))
    stretches = shards.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / TILE_SLOTS) - 1, F.lit(0)))))
    stretches = stretches.select("lang", "shard", "stretch", F.least(F.lit(TILE_SLOTS), F.col("n") - F.col("stretch") * TILE_SLOTS).alias("n_slots"))

    def in_tiles(rows: DataFrame) -> DataFrame:
        """A row in every tile of its stretch of sources and another."""
        own = F.floor(F.col("number") / TILE_SOURCES)
        spread = rows.join(parts, "lang").withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        return spread.withColumns({"low": F.least(own, "_other"), "high": F.greatest(own, "_other")}).drop("_other", "parts")

    tile = ["lang", "shard", "stretch", "low", "high"]
    entries = in_tiles(counts.withColumn("stretch", F.floor(F.col("slot") / TILE_SLOTS)).select("lang", "shard", "stretch", "slot", "number", "n"))
    sides = in_tiles(groups.select("lang", "number", "total", "kept").join(stretches, "lang"))
    met = entries.groupBy(*tile).cogroup(sides.groupBy(*tile)).applyInPandas(_tiled(TILE_SLOTS, TILE_SOURCES), "lang string, a long, b long, value long")
    return met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audited(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, best: int = BEST_TERMS, terms_a_shard: int = SHARD_TERMS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) as the contract has it: how far each source of a language is from the others,
    and the terms that it uses most above the language.

    Null lang, source and text are ''. Every row is a document, repeated ones too; ids and other columns are not read.
    Texts of any length are read whole. Equal values rank by the item's bytes. An empty table gives no rows; a
    language without kept terms has pairs of value 0.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = staged(document_frequencies(rows).filter(F.col("n") >= least_documents).select("lang", "term"), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    shards = staged(shards_of(kept, sizes, terms_a_shard), "shards")
    weight = shards.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    passes = max(1, math.ceil(weight / pass_bytes))
    found = None
    for number in range(passes):
        own = shards.filter(F.pmod(F.xxhash64("lang", "shard"), F.lit(passes)) == number).collect()  # about pass_bytes
        part = staged(recounted(rows, own), "counts")
        found = part if found is None else found.unionByName(part)
    present = rows.select("lang", "source").distinct()
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = present.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "kept"])
    groups = staged(groups.withColumn("number", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long") - 1), "groups")

    held = shards.select("lang", "shard", "n")
    bare = groups.filter("kept = 0").select("lang", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("n")).distinct()
    numbered = staged(found.join(groups.select("lang", "source", "number"), ["lang", "source"]), "numbered")
    pairs = staged(source_pairs(numbered, groups, held.unionByName(bare)), "pairs")
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda n, s: groups.select("lang", F.col("number").alias(n), F.col("source").alias(s))
    pair_rows = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    slot = ["lang", "shard", "slot"]
    whole = found.groupBy(*slot).agg(F.sum("n").alias("_n"))
    lang_totals = groups.groupBy("lang").agg(F.sum("total").alias("_total"))
    terms = shards.select("lang", "shard", F.posexplode("terms").alias("slot", "item")).withColumn("item", F.col("item").cast("string"))
    used = found.join(groups.select("lang", "source", "total", "kept"), ["lang", "source"]).join(whole, slot).join(lang_totals, "lang")
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("_n"), F.col("_total"), F.col("kept"))
    above = used.withColumns({"_p": p, "_q": q}).filter("_p > _q").withColumn("value", distance(F.col("_p"), F.col("_q"))).select(*slot, "source", "value")
    term_rows = above.join(terms, slot).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    term_rows = term_rows.withColumn("rank", rank).filter(F.col("rank") <= best)
    return pair_rows.withColumn("rank", rank).unionByName(term_rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


#: The same result from all occurrences of all terms.
SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
t as (select lang, source, r, unnest(terms) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct r) >= 10),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t group by all),
f as (select g.lang, g.source, k.term, coalesce(n, 0) as n from g join kept k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
l as (select lang, term, sum(n) as n from f group by lang, term),
p as (select *, cast(1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * count(*) over (partition by lang, source)) as bigint) as p from f),
q as (select *, cast(1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang) + 2 * count(*) over (partition by lang)) as bigint) as p from l),
pairs as (select a.lang, a.source, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as bigint) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all select a.lang, a.source, b.source, 0 from g a join g b on a.lang = b.lang and a.source <> b.source where a.lang not in (select lang from kept)),
terms as (select p.lang, p.source, p.term as item, (p.p - q.p) * (p.p - q.p) // (p.p + q.p) as value from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.p),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (
  select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms))
select lang, source, part, item, value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 10
"""
