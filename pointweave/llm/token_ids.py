"""Token ids of whole texts by the tokenizers library, as packed little-endian 32-bit numbers.

Texts are cut into parts before lone blanks, and around full stops, commas and line feeds where that is safe. Arrow
numbers the distinct parts of a batch, so that Python looks at each of them once; a bounded table remembers those of
earlier batches, and the library's model encodes the pre-tokens of what is new. Cutting there changes nothing: with a
byte-level pattern a lone blank always begins a new pre-token, and special strings hold no blank.
"""

from __future__ import annotations

import functools
import gc
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A blank with no other white space beside it (Python's white space includes all that the library's has).
_LONE = re.compile(r"(?<!\s) (?!\s)")
_BESIDE = re.compile(r" \s|\s ")
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Entries that one generation of a task's tables of parts and of pre-tokens holds (about 200 bytes each; Spark keeps
#: the processes of its tasks, so the tables stay in memory), and the longest part that is kept.
_KEEP, _KEEP_WORDS, KEEP_LENGTH = 75_000, 25_000, 64
#: Below this character, the pattern of byte-level vocabularies splits alike in the regex module and in the library
#: (whose Unicode tables are older); chunks with later characters are split by the library.
SAFE_BELOW = "\u0250"


def vocabulary(name: str) -> str:
    """The place of a vocabulary file: a path, or a name that the public_tokenizers package resolves on each machine."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(text: str) -> list[str]:
    """text cut before its lone blanks."""
    beside = "  " in text or " \n" in text or "\n " in text or (_OTHER_SPACE.search(text) and _BESIDE.search(text))
    parts = _LONE.split(text) if beside else text.split(" ")
    out = [f" {p}" for p in parts]
    out[0] = parts[0]
    return out if out[0] else out[1:]


def _kind(byte: int) -> str:
    c = chr(byte)
    return " " if c == " " else "n" if c == "\n" else "w" if c.isspace() or byte == 0 else "a" if c.isalnum() else "p" if c in ".," else "q"


#: By Latin-1 byte: a letter or digit, p full stop or comma, q other mark, n line feed, w other white space.
_KINDS = "".join(map(_kind, range(256))).encode()
#: Neighbours that one pre-token may join, or that belong to a run of white space.
_TOGETHER = (b"w", b"pp", b"pq", b"qp", b"qq", b" p", b"  ", b" n", b"n ", b"nn")


def small_parts(text: str) -> str | None:
    """text with a zero where it is cut: before blanks and around line feeds, full stops and commas, with empty parts
    between; None where a pre-token could span a cut, or for texts beyond Latin-1."""
    try:
        kinds = text.encode("latin-1").translate(_KINDS)
    except UnicodeEncodeError:
        return None
    for pair in _TOGETHER:
        if pair in kinds:
            return None
    return text.replace(".", "\0.\0").replace(",", "\0,\0").replace("\n", "\0\n\0").replace(" ", "\0 ")


def parted(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct, codes, starts, ends): text i is the distinct parts numbered codes[starts[i] : ends[i]], in order."""
    cut = [small_parts(t) if t else "" for t in texts]
    other = [i for i, c in enumerate(cut) if c is None]
    lists = pc.split_pattern(pa.array(cut, pa.large_string()), "\0")  # null where it is None
    parts, counts = lists.flatten(), np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    if other:
        more = [chunks(texts[i]) for i in other]
        parts = pa.concat_arrays([parts, pa.array([p for m in more for p in m], pa.large_string())])
        order = np.concatenate([np.delete(np.arange(len(texts)), other), other]).astype(np.int64)
        counts[other] = [len(m) for m in more]
    else:
        order = np.arange(len(texts))
    named = parts.dictionary_encode()
    ends = np.empty(len(texts), np.int64)
    ends[order] = np.cumsum(counts[order])
    return named.dictionary.to_numpy(zero_copy_only=False).tolist(), named.indices.to_numpy(), ends - counts, ends


class Recent:
    """A bounded table of two generations: a full young one takes the old one's place, and what is used again stays."""

    def __init__(self, keep: int = _KEEP):
        self.young, self.old, self.keep = {}, {}, keep

    def missing(self, keys) -> list:
        """Keys that neither generation holds; the others are young afterwards."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out

    def forget_long(self, keys) -> None:
        for k in keys:
            if len(k) > KEEP_LENGTH:
                self.young.pop(k, None)

    def settle(self) -> None:
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it has a shape, else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class IdEncoder:
    def __init__(self, name: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        cut = self.tokenizer.pre_tokenizer
        if type(cut).__name__ != "ByteLevel" or cut.add_prefix_space or not cut.use_regex or self.tokenizer.normalizer is not None:
            raise ValueError(f"{name}: cutting at blanks is shown right for byte-level vocabularies with their usual pattern only")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize, self.symbols = self.tokenizer.model.tokenize, dict(enumerate(byte_symbols()))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts, self.words = Recent(), Recent(_KEEP_WORDS)

    def _word(self, word: str) -> bytes:
        """Ids of a pre-token, by the library's model alone."""
        shown = "\u0120" + word[1:] if word[0] == " " and word.isascii() and word[1:].isalnum() else word.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def _part(self, part: str) -> bytes:
        if max(part, default="") >= SAFE_BELOW or any(s in part for s in self.special):
            return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        words, known = self.split(part), self.words.young
        for w in self.words.missing(words):
            known[w] = self._word(w)
        out = b"".join([known[w] for w in words])
        self.words.forget_long(words)
        self.words.settle()
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text, four bytes each; of null as of the empty text."""
        distinct, codes, starts, ends = parted(texts)
        new, known = self.parts.missing(distinct), self.parts.young
        for p in new:
            single = p[:1] == " " and p[1:].isalpha() and (p.isascii() or max(p) < SAFE_BELOW)  # a pre-token as it is
            known[p] = self._word(p) if single else self._part(p)
        found = [known[p] for p in distinct]
        self.parts.forget_long(new)
        self.parts.settle()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        values, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        sizes, at = sizes[codes], at[codes]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ids = values[np.arange(bounds[-1]) + np.repeat(at - bounds[:-1], sizes)].tobytes()
        return [ids[4 * a : 4 * b] for a, b in zip(bounds[starts].tolist(), bounds[ends].tolist())]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


@functools.lru_cache(maxsize=2)
def encoder(name: str) -> IdEncoder:
    """One encoder a task process. Its tables hold no cycles, so the collector need not go through new lists so often."""
    gc.set_threshold(200_000)
    return IdEncoder(name)
