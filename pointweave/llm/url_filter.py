"""URL filters: rules for hosts and paths, and for all other urls a naive Bayes model on segmented names.

Words of the pages' text give unigram counts. A name such as a host label is split into the likeliest words by a
Viterbi pass over those of its parts that occur in the text. Urls that a rule decides train a multinomial naive Bayes
model on host words and path tokens, which decides the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.tables import table
from pointweave.plans.scratch import staged

#: (verdict, host and path): a rule fits its host and all subdomains where the path starts with its path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Added to every count of the naive Bayes model.
SMOOTHING = 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url"):
    """From the first :// to the next / ? # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: str = "url"):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^/?#]*([^?#]*)", 1)


def rule_of(rules=RULES, host: str = "host", path: str = "path"):
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rules=RULES, rule: str = "rule"):
    verdict = F.lit(None).cast("string")
    for v, r in rules:
        verdict = F.when(F.col(rule) == r, F.lit(v)).otherwise(verdict)
    return verdict


def split_name(name: str, parts: list[tuple[int, int, int]], total: int) -> list[str]:
    """The likeliest words of a name: parts are (start, length, count) of known words, total is the sum of all counts.

    An unknown part of n letters has the probability 10 / (total * 10 ** n). Of equal splits the one with the
    longest last word stays, and so on backwards.
    """
    by_end: dict[int, dict[int, int]] = {}
    for start, length, count in parts:
        by_end.setdefault(start + length, {})[start] = count
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    base = math.log(max(total, 1))
    unknown, loss = math.log(10) - base, math.log(10)
    leading, since = -math.inf, 0  # of the unknown parts that end here: the best start, by its score and ten to its place
    for end in range(1, len(name) + 1):
        if best[end - 1] + loss * (end - 1) > leading:
            leading, since = best[end - 1] + loss * (end - 1), end - 1
        best[end], back[end] = leading + unknown - loss * end, since
        for start, count in sorted(by_end.get(end, {}).items()):
            p = best[start] + math.log(count) - base
            if p > best[end] or (p == best[end] and start < back[end]):
                best[end], back[end] = p, start
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) of the pages' text without tags, letters only, in lower case."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = F.split(F.lower(text), r"[^\p{L}]+")
    return pages.select(F.explode(words).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def name_segments(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words array<string>) for distinct names; words is a written table (word, n)."""
    total = int(words.agg(F.sum("n")).first()[0] or 0)
    longest = words.agg(F.max(F.length("word")).alias("longest"))  # one row
    starts = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start")).crossJoin(F.broadcast(longest)).filter("longest > 0")
    fitting = F.sequence(F.lit(1), F.least(F.col("longest"), F.length("name") - F.col("start") + 1))
    parts = starts.select("name", "start", F.explode(fitting).alias("length")).withColumn("word", F.expr("substring(name, start, length)"))
    known = parts.join(words, "word").groupBy("name").agg(F.collect_list(F.struct(F.col("start") - 1, "length", "n")).alias("parts"))  # known parts of one name
    rows = names.join(known, "name", "left")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [split_name(name, [tuple(p.values()) for p in parts or []], total) for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["name", "words"])

    return rows.select("name", "parts").mapInArrow(split, "name string, words array<string>")


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words): the words of a host's names, which dots, hyphens and digits part, in order."""
    named = staged(hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}]+")).alias("at", "name")).filter("name <> ''"), "names")
    segments = staged(name_segments(named.select("name").distinct(), words), "segments")
    ordered = F.array_sort(F.collect_list(F.struct("at", "words")))
    return named.join(segments, "name").groupBy("host").agg(F.flatten(F.transform(ordered, lambda x: x["words"])).alias("words"))


def path_tokens(path: str = "path"):
    """Runs of letters and digits, A-Z in lower case, every number alike."""
    parts = F.filter(F.split(F.translate(path, _UPPER, _LOWER), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\p{N}+$"), F.lit("0")).otherwise(x))


def judged_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, block_score.

    verdict is the rule's, else the model's: block if block_score, the log-odds of blocking, is above 0. The model
    is trained on all pages that a rule decides; tokens that it has not seen say nothing; where no rule decides
    anything the score is 0. A null url, or one without ://, has an empty host and path. Null ids and repeated rows
    are judged like others; null html gives no words; other columns are not read; an empty table gives no rows.
    """
    url = F.coalesce(F.col("url"), F.lit("")).alias("url")
    urls = pages.select(url).groupBy("url").agg(F.count("*").alias("pages"))
    urls = staged(urls.withColumn("host", host_of()).withColumn("path", path_of()).withColumn("rule", rule_of(rules)).withColumn("known", rule_verdict(rules)), "urls")
    words = staged(word_counts(pages), "words")
    segmented = staged(host_words(urls.select("host").distinct(), words), "hosts")
    named = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w))
    pathed = F.transform(path_tokens(), lambda w: F.concat(F.lit("p:"), w))
    tokens = staged(urls.join(segmented, "host", "left").select("url", "pages", "known", F.explode(F.concat(named, pathed)).alias("token")), "tokens")

    blocked, allowed = (F.sum(F.when(F.col("known") == v, F.col("pages")).otherwise(0)) for v in ("block", "allow"))
    seen = staged(tokens.filter("known is not null").groupBy("token").agg(blocked.alias("block"), allowed.alias("allow")), "seen")
    n_block, n_allow, kinds = seen.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    pages_block, pages_allow = urls.agg(blocked, allowed).first()
    prior = math.log((pages_block + SMOOTHING) / (pages_allow + SMOOTHING)) if pages_block or pages_allow else 0.0
    space = SMOOTHING * (kinds or 1)
    shift = math.log(((n_allow or 0) + space) / ((n_block or 0) + space))
    weights = staged(seen.select("token", (F.log(F.col("block") + SMOOTHING) - F.log(F.col("allow") + SMOOTHING) + shift).alias("weight")), "weights")
    scores = tokens.filter("known is null").join(weights, "token").groupBy("url").agg(F.sum("weight").alias("weight"))
    decided = staged(
        urls.join(staged(scores, "scores"), "url", "left").select("url", "host", "path", "rule", "known", F.when(F.col("known").isNull(), F.coalesce("weight", F.lit(0.0)) + prior).alias("block_score")),
        "decided",
    )
    verdict = F.coalesce("known", F.when(F.col("block_score") > 0, "block").otherwise("allow"))
    return pages.select("page_id", url).join(decided, "url").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_pages(table(spark, sf_dir, "pages"))
