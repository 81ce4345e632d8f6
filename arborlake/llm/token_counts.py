"""Token counts by greedy longest match in linear time, without building pieces.

The vocabulary becomes a trie of bytes.  Each node has a failure link and the number of
pieces popped when following it (after LinMaxMatch, Song et al. 2021), so that every byte of
a word costs amortised constant work and only a count is kept.

The vocabulary file is one of byte-level pieces with a word-end mark (``</w>``): a piece with
the mark only ends a word, one without it stands anywhere.  A word's bytes and then the end
symbol 256 are matched greedily from the left; an end symbol that no piece took along counts
nothing.  A word with a place that no piece matches counts as one unknown token.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


END = 256
#: Runs of letters, single digits, runs of other characters; white space separates.
WORDS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for the 256 bytes: printable Latin-1
    stands for itself, the other bytes follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load_pieces(path: str, end_mark: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces of a tokenizer file as byte sequences, with END last where the mark stands;
    special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    alphabet, out = byte_alphabet(), []
    for piece in spec["model"]["vocab"]:
        if piece in special:
            continue
        stem, ends = (piece[: -len(end_mark)], True) if piece.endswith(end_mark) else (piece, False)
        if all(ch in alphabet for ch in stem):
            out.append((*[alphabet[ch] for ch in stem], *([END] if ends else [])))
    return out


class Automaton:
    """Trie with failure links.  ``go``: (node << 9 | symbol) -> node; ``fail``: node, or -1
    if a match can't go on; ``pops``: pieces that following the link completes."""

    def __init__(self, pieces: list[tuple[int, ...]]) -> None:
        go: dict[int, int] = {}
        final = [False]
        for piece in [(END,), *pieces]:
            v = 0
            for s in piece:
                u = go.get(v << 9 | s)
                if u is None:
                    u = go[v << 9 | s] = len(final)
                    final.append(False)
                v = u
            final[v] = final[v] or v != 0
        children: list[list[tuple[int, int]]] = [[] for _ in final]
        for key, u in go.items():
            children[key >> 9].append((key & 511, u))
        bare_end = go[END]
        fail, pops = [-1] * len(final), [0] * len(final)
        level = [0]
        while level:
            below = []
            for v in level:
                for s, u in children[v]:
                    below.append(u)
                    if final[u]:
                        fail[u], pops[u] = 0, int(u != bare_end)
                        continue
                    z, popped = fail[v], pops[v]
                    while z >= 0 and (z << 9 | s) not in go:
                        popped += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[u], pops[u] = go[z << 9 | s], popped
            level = below
        self.go, self.fail, self.pops = go, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of one word; 1 if it can't be split."""
        go, fail, pops = self.go.get, self.fail, self.pops
        v = n = 0
        for s in (*word, END):
            u = go(v << 9 | s)
            while u is None:
                if fail[v] < 0:
                    return 1
                n += pops[v]
                v = fail[v]
                u = go(v << 9 | s)
            v = u
        while v:
            if fail[v] < 0:
                return 1
            n += pops[v]
            v = fail[v]
        return n


class CountCache(dict):
    """word -> pieces, emptied when ``limit`` words are held; long words are never kept."""

    def __init__(self, automaton: Automaton, limit: int = 200_000) -> None:
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word.encode("utf-8", "replace"))
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


@dataclass(frozen=True)
class TokenCount:
    """``vocab``: path of the vocabulary file, read by the driver.  ``max_vocab_bytes``: the
    automaton is broadcast, so a file beyond this size is refused."""

    vocab: str
    max_vocab_bytes: int = 64 << 20


def token_count_column(spark: SparkSession, p: TokenCount):
    """A function Column -> struct<n_words, n_tokens> over whole texts.  Null or empty text:
    zeros.  Words are lower-cased as the vocabulary is."""
    import os

    if os.path.getsize(p.vocab) > p.max_vocab_bytes:
        raise ValueError(f"{p.vocab} is larger than {p.max_vocab_bytes} bytes; raise max_vocab_bytes if executors can hold it")
    shared = spark.sparkContext.broadcast(Automaton(load_pieces(p.vocab)))

    @F.pandas_udf("n_words long, n_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = shared.value  # one object in a worker for all its tasks
        get = vars(automaton).setdefault("cache", CountCache(automaton)).__getitem__
        for texts in batches:
            words, tokens = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            for i, text in enumerate(texts):
                if text:
                    found = WORDS.findall(text.lower())
                    words[i], tokens[i] = len(found), sum(map(get, found))
            yield pd.DataFrame({"n_words": words, "n_tokens": tokens})

    return count


def token_counts(docs: DataFrame, p: TokenCount, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_tokens for every row, repeated rows included; row order, other
    columns and partitioning play no part."""
    count: Column = token_count_column(docs.sparkSession, p)(F.col(text).cast("string"))
    return docs.select(F.col(id_col), count.alias("c")).select(id_col, "c.n_words", "c.n_tokens")
