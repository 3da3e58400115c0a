"""License scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pointweave.llm.tables import limit_batches, table
from pointweave.llm.words import plain_words, utf8

#: Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices. A phrase is a run of whole words, in lower case and without punctuation.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "isc license": "isc",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by nd": "cc-by-nd",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: Tags as texts spell them; a colon and the expression follow.
TAGS = ("spdx-license-identifier",)
#: How freely a work under a label may be used: 1 freely, 0 not.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "apache-2.0": 1.0, "bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "cc0": 1.0, "cc0-1.0": 1.0, "unlicense": 1.0, "public-domain": 1.0, "cc-by": 0.9, "cc-by-4.0": 0.9,
    "mpl": 0.6, "mpl-2.0": 0.6, "epl": 0.6, "epl-2.0": 0.6, "lgpl": 0.5, "lgpl-2.1": 0.5, "lgpl-3.0": 0.5, "cc-by-sa": 0.4, "cc-by-sa-4.0": 0.4,
    "gpl": 0.3, "gpl-2.0": 0.3, "gpl-3.0": 0.3, "agpl": 0.2, "agpl-3.0": 0.2, "cc-by-nd": 0.1, "cc-by-nc": 0.1, "cc-by-nc-4.0": 0.1, "proprietary": 0.0,
}
#: A label that is not in the table.
UNKNOWN_FREEDOM = 0.2
#: An exception to a license's terms moves it this share of the way to free use.
EXCEPTION_GAIN = 0.5

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_COLON = re.compile(r"[ \t]*:")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")


def parse_expression(text: str, at: int = 0) -> tuple[list[str], list[str]]:
    """Postfix order of the license expression that starts at a place of a text, and the labels in it.

    Shunting-yard: WITH binds closer than AND, AND closer than OR, all to the left. What is not an expression ends
    it, as do the end of the line and the next tag: the longest start that parses counts, however long. Identifiers are in lower case, without -only, -or-later and +.
    """
    out: list[str] = []
    operators: list[str] = []
    operand_next, opened = True, 0
    done, rest = 0, []  # the longest start: so much of out, then these operators (three at most)
    for match in _TOKEN.finditer(text, at):
        between = text[at : match.start()]
        if between.strip() or "\n" in between or "\r" in between:
            break
        at, token = match.end(), match.group().lower()
        if token.startswith("spdx-license-identifier:"):
            break
        if token == "(":
            if not operand_next:
                break
            operators.append(token)
            opened += 1
        elif token == ")":
            if operand_next or not opened:
                break
            while operators[-1] != "(":
                out.append(operators.pop())
            operators.pop()
            opened -= 1
        elif token in _PRECEDENCE:
            if operand_next:
                break
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[token]:
                out.append(operators.pop())
            operators.append(token)
            operand_next = True
            continue
        else:
            if not operand_next:
                break
            out.append(re.sub(r"(-only|-or-later|\+|\.)$", "", token))
        operand_next = token == "("
        if not operand_next and not opened:
            done, rest = len(out), operators[::-1]
    best = out[:done] + rest
    labels, license = [], [True]  # from the last operator back, whether an operand is one or an exception
    for token in reversed(best):
        wanted = license.pop()
        if token in _PRECEDENCE:
            license += [wanted, wanted and token != "with"]
        elif wanted:
            labels.append(token)
    return best, labels[::-1]


def evaluate_expression(postfix: list[str], freedom: dict[str, float]) -> float | None:
    """How freely the work may be used: the freest choice of OR, the strictest part of AND; WITH loosens a license."""
    stack: list[float] = []
    for token in postfix:
        if token in _PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append(max(left, right) if token == "or" else min(left, right) if token == "and" else left + (1 - left) * EXCEPTION_GAIN)
        else:
            stack.append(freedom.get(token, UNKNOWN_FREEDOM))
    return stack[0] if stack else None


class Scanner:
    """One automaton for all phrases and tags, over the words of a text joined and bounded by blanks, and one for the tags' places in it as it is."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], freedom: dict[str, float]):
        import ahocorasick

        self.base, self.freedom = base, freedom
        self.automaton = ahocorasick.Automaton()
        for phrase in {*base, *notices, *TAGS}:
            words = b" ".join(plain_words(phrase)).decode("latin-1")
            label = base.get(phrase) or notices.get(phrase)
            self.automaton.add_word(f" {words} ", (len(words) + 1, phrase in base, label))
        self.automaton.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()

    def expressions(self, text: str | None) -> Iterator[tuple[list[str], list[str]]]:
        """The expressions behind a text's tags, which the automaton finds in its bytes."""
        spelled = utf8(text).lower().decode("latin-1")
        for end, _ in self.tags.iter(spelled):
            colon = _COLON.match(spelled, end + 1)
            if colon:
                yield parse_expression(spelled, colon.end())

    def scan(self, text: str | None) -> tuple:
        words = plain_words(text)
        joined = b" ".join([b"", *words, b""]).decode("latin-1")
        places, base_labels, labels, tagged = [], set(), set(), False
        at = before = 0  # blanks before a place that moves on with the hits, so that a text is counted through once
        for end, (length, is_base, label) in self.automaton.iter(joined):
            if is_base:
                start = end - length
                before += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
                at = start
                places.append(before)
                base_labels.add(label)
            if label:
                labels.add(label)
            else:
                tagged = True
        score = min([self.freedom.get(x, UNKNOWN_FREEDOM) for x in labels], default=0.5)
        if tagged:
            values = []
            for postfix, found in self.expressions(text):
                if postfix:
                    labels.update(found)
                    values.append(evaluate_expression(postfix, self.freedom))
            score = min(values, default=score)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), float(score)


@functools.lru_cache(maxsize=4)
def _scanner(base: tuple, notices: tuple, freedom: tuple) -> Scanner:
    return Scanner(dict(base), dict(notices), dict(freedom))


def with_licenses(docs: DataFrame, base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES, freedom: dict[str, float] = FREEDOM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are their least and greatest first words
    (from 0, null without any). labels has those of notices and of tagged expressions too. score, 0 to 1, is how
    freely the document may be used: its tagged expressions decide if there are any, else the strictest notice;
    0.5 where nothing is found. Texts are read whole, in time that grows with their length. A null or empty text has no words; null ids and repeated rows are scanned like
    others; other columns are not read. No shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spec = tuple(tuple(sorted(d.items())) for d in (base, notices, freedom))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(*spec).scan
        for batch in batches:
            columns = list(zip(*map(scan, batch.column(1).to_pylist()))) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    limit_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_licenses(table(spark, sf_dir, "documents"))
