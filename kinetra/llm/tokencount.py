"""Token counts with a shortcut for whole tokens.

Offline, every vocabulary string that encodes alone as one token is found with the library itself. A text's pre-tokens
that are such strings count one each; only the rest are merged. Normalising is the library's; pre-tokens are cut by
a pattern whose letter and number classes are asked of the library, code point by code point.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinetra.llm.kernel import slices
from kinetra.llm.packing import public_path
from kinetra.llm.scratch import bound_batches

LIMIT = 2048
#: Code points whose class is asked for; a text with one beyond is cut by the library.
ASKED = 0x20000
#: Texts under these bounds get smaller, faster classes; under the second one there are no marks that combine.
BOUNDS = (0x80, 0x100, 0x10000)
#: Characters of a text that are normalised at once; it is cut at a blank only, which no pre-token spans.
PART = 1 << 20
#: Merged counts that a task keeps, of words up to so many characters.
KEPT_WORDS, KEPT_LENGTH = 1 << 19, 64


class Cutter:
    """Pre-tokens of a ``word_bpe`` file: contractions, runs of letters, single numbers, runs of other marks."""

    def __init__(self, text: str) -> None:
        model = json.loads(text)
        split, bytes_ = model["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in model["normalizer"]["normalizers"]]
        if (split["type"], split["invert"], bytes_["type"], kinds) != ("Split", True, "ByteLevel", ["NFC", "Replace", "Lowercase"]):
            raise ValueError("this is not a word_bpe tokenizer")
        self.added = [t["content"] for t in model["added_tokens"]]
        whole = Tokenizer.from_str(text)
        self.normal = whole.normalizer
        self.split = whole.pre_tokenizer
        self.model = whole.model
        self.vocabulary = model["model"]["vocab"]
        self.letters = _byte_letters()

    def classes(self) -> tuple[list[int], list[int], list[int]]:
        """The letters, numbers and blanks among the code points asked for. A code point stands
        twice between two b: a letter gives one pre-token, a number four, a blank two and any other mark three."""
        kinds = {1: [], 4: [], 2: []}
        for start in range(0, ASKED, 1 << 14):
            points = [c for c in range(start, start + (1 << 14)) if not 0xD800 <= c < 0xE000]
            text = " ".join(f"b{chr(c)}{chr(c)}b" for c in points)
            found = [0] * len(points)
            for _, (at, _) in self.split.pre_tokenize_str(text):
                found[at // 5] += 1
            for c, n in zip(points, found):
                if n in kinds:
                    kinds[n].append(c)
        return kinds[1], kinds[4], kinds[2]

    def words(self, normal: str) -> list[str]:
        """Pre-tokens of a normalised text by the library (slow)."""
        return [normal[a:b] for _, (a, b) in self.split.pre_tokenize_str(normal)]

    def whole(self) -> set[str]:
        """The pre-tokens that are one token: vocabulary strings that the library, given them alone, encodes as one."""
        alphabet = {v: k for k, v in self.letters.items()}
        found = set()
        for token in self.vocabulary:
            letters = token.removesuffix("</w>")
            if letters == token or not all(c in alphabet for c in letters):
                continue
            try:
                word = bytes(alphabet[c] for c in letters).decode()
            except UnicodeDecodeError:
                continue
            if self.normal.normalize_str(word) == word and self.words(word) == [word]:
                found.add(word)
        return {w for w in found if self.merged(w) == 1}

    def merged(self, word: str) -> int:
        """Tokens of one pre-token. The model's alphabet has ASCII marks for themselves, other bytes by a table."""
        return len(self.model.tokenize(word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)))


def _byte_letters() -> dict[int, str]:
    """byte -> the letter that stands for it: the printable ones of Latin-1 for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(other)}


def _ranges(points: list[int]) -> str:
    """The code points as ranges of a pattern's class."""
    out, at = [], 0
    while at < len(points):
        to = at
        while to + 1 < len(points) and points[to + 1] == points[to] + 1:
            to += 1
        out.append(f"\\U{points[at]:08x}-\\U{points[to]:08x}" if to > at else f"\\U{points[at]:08x}")
        at = to + 1
    return "".join(out)


class _Costs(dict):
    """pre-token -> tokens: 1 for whole tokens; others are merged once, and kept while there is room."""

    def __init__(self, one: frozenset[str], merged) -> None:
        super().__init__(dict.fromkeys(one, 1))
        self.merged, self.one = merged, one

    def __missing__(self, word: str) -> int:
        n = self.merged(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS + len(self.one):
                self.clear()
                self.update(dict.fromkeys(self.one, 1))
            self[word] = n
        return n


class Counter:
    """text -> number of tokens, in a task; ``plan`` is what ``offline`` made."""

    def __init__(self, plan: dict) -> None:
        self.cut = Cutter(plan["file"])
        self.costs = _Costs(plan["whole"], self.cut.merged)
        self.patterns = [re.compile(rf"[{a}]+|'(?:[stmd]|re|ve|ll)|[{n}]|[^{s}{a}{n}]+") for a, n, s in plan["classes"]]
        self.wide = [re.compile(f"[\\U{c:08x}-\\U0010ffff]") for c in (*BOUNDS, ASKED)]
        self.lower = plan["lower"]
        self.special = re.compile("|".join(map(re.escape, sorted(self.cut.added, key=len, reverse=True)))) if self.cut.added else None

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART:
            to = text.find(" ", at + PART)
            if to < 0:
                break
            yield text[at:to]
            at = to
        yield text[at:]

    def words(self, text: str) -> list[str]:
        normal = text.lower() if self.lower and not self.wide[1].search(text) else self.cut.normal.normalize_str(text)
        if normal.isascii():
            return self.patterns[0].findall(normal)
        for wide, pattern in zip(self.wide[1:], self.patterns[1:]):
            if not wide.search(normal):
                return pattern.findall(normal)
        return self.cut.words(normal)

    def plain(self, text: str) -> int:
        return sum(sum(map(self.costs.__getitem__, self.words(part))) for part in self.parts(text))

    def __call__(self, text: str) -> int:
        """Added tokens inside the text are taken out first and count one each, as the library does by default."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        between = self.special.split(text)
        return sum(map(self.plain, between)) + len(between) - 1


def offline(path: str) -> dict:
    """What tasks need, worked out once: the file, its whole-token strings and its classes (bounded by the vocabulary), and
    whether normalising Latin-1 text is no more than lower-casing and making blanks one."""
    text = open(path, encoding="utf-8").read()
    cut = Cutter(text)
    kinds = cut.classes()
    classes = [tuple(_ranges([c for c in kind if c < bound]) for kind in kinds) for bound in (*BOUNDS, ASKED)]
    latin = [c for c in range(BOUNDS[1]) if c not in kinds[2]]
    same = all(cut.normal.normalize_str(f"b{chr(c)}b") == f"b{chr(c)}b".lower() for c in latin)
    return {"file": text, "whole": frozenset(cut.whole()), "classes": classes, "lower": same}


_counters: dict[str, Counter] = {}


def _counter(key: str, plan) -> Counter:
    """One counter for all tasks that this Python process gets; its table of merged words is bounded."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(plan.value)
    return _counters[key]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text, ...)``.

    Tokens are those of the ``word_bpe`` file at ``path`` without added ones; strings of added tokens inside a text are
    such tokens. Null text counts as empty (0 tokens). Texts of any length are counted whole, part by part. Repeated rows
    count each; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    plan = offline(path or public_path("word_bpe_49k.json"))
    key, held = hashlib.sha256(plan["file"].encode()).hexdigest(), spark.sparkContext.broadcast(plan)

    def run(batches):
        count = _counter(key, held)
        for batch in slices(batches, most=1 << 20):
            n = [count(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_tokens(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
