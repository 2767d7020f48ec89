"""Token counts under a byte-level BPE vocabulary.

Texts are cut into pre-tokens; the distinct pre-tokens of a slice that have not been seen
become one ragged array of symbols. In each round every sequence merges all occurrences of
its own lowest-rank pair, in all sequences at once; what is left is counted.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from inductra.llm.common import slices
from inductra.llm.merging import Rules, merge

#: The split of byte-level BPE files with ``use_regex``; a fixed value of that format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens whose counts one Python worker remembers.
REMEMBERED = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A vocabulary file: its merge rules, special strings and the counting itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self._check(model)
        vocab = model["model"]["vocab"]
        self.first = np.zeros(256, np.int64)
        for char, byte in byte_alphabet().items():
            self.first[byte] = vocab[char]
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.rules = Rules(pairs)
        special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    @staticmethod
    def _check(model: dict) -> None:
        """Refuse files whose rules are not those implemented here."""
        before = model.get("pre_tokenizer") or {}
        options = model["model"]
        plain = (
            options["type"] == "BPE"
            and model.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not options.get("ignore_merges")
            and not options.get("dropout")
            and not options.get("continuing_subword_prefix")
            and not options.get("end_of_word_suffix")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"])
        )
        if not plain:
            raise ValueError("only plain byte-level BPE files are supported")

    def count(self, tokens: list[str]) -> np.ndarray:
        """Symbols left of each pre-token."""
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        return merge(self.rules, self.first[np.frombuffer(b"".join(raw), np.uint8)], sizes)[1]

    def text_counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for start, run in slices(texts):
            cut = [self._pieces(text) for text in run]
            known = self.known
            unseen = list({t for pieces, _ in cut for t in pieces if t not in known})
            if len(known) + len(unseen) > REMEMBERED:
                known.clear()
                unseen = list({t for pieces, _ in cut for t in pieces})
            known.update(zip(unseen, self.count(unseen).tolist() if unseen else ()))
            for i, (pieces, specials) in enumerate(cut):
                out[start + i] = sum(map(known.__getitem__, pieces)) + specials
        return out

    def _pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stood between them."""
        if self.special is None or not self.special.search(text):
            return self.split(text), 0
        parts = self.special.split(text)
        return [t for part in parts for t in self.split(part)], len(parts) - 1


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text as the vocabulary file at ``path`` gives them, as a column.

    Null and empty texts have none. Strings of special tokens inside a text are one token
    each, as is that library's default. Row by row, so repeated rows, other columns and
    their names do not matter; a text of any length is counted whole.
    """

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(merges(path).text_counts(texts.to_pylist()), pa.int64())

    return counted(text)
