"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. One pass counts, over all documents, how many hold each n-gram (3 words) of the test items.
2. In every run of ``spread`` consecutive n-grams of an item the rarest one that occurs becomes
   a seed.  So a copy is found if any gram + spread - 1 words in a row (4) were left as they
   are, and however often the item was copied.
3. A second pass finds the seeds in whole documents.  The passage around an item's seeds is
   aligned with the item by words (match 1, mismatch and gap -``penalty``), unless even all
   words that passage and item share could not reach the least score, which prunes exactly.
4. A copy is reported if the alignment scores ``share`` of the item's words, or ``run`` words.
   An item of fewer than ``min_words`` words gives too little to align: it is found where all
   its words stand in a row.

Words are lower-cased and stripped of punctuation at their ends.  Items go through in blocks
of at most ``block_words`` words, each broadcast; a larger benchmark takes more blocks, not a
larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


EDGE = b".,;:!?\"'()[]{}<>*#~_-"


@dataclass(frozen=True)
class Decon:
    """``share`` and ``run``: least alignment score as a share of the item's words, or in
    words.  ``min_words``: shorter items are found by equality.  ``slack``: words
    on either side of the passage that an edited copy may have gained."""

    gram: int = 3
    spread: int = 2
    share: float = 0.5
    run: int = 13
    penalty: float = 0.5
    min_words: int = 5
    slack: int = 8
    block_words: int = 1_000_000


class WordIds(dict):
    """word as written -> id of the stripped, lower-case word; 0 unknown, -1 nothing left."""

    def __init__(self, ids: dict[bytes, int], limit: int = 200_000) -> None:
        super().__init__()
        self.ids, self.limit = ids, limit

    def __missing__(self, token: bytes) -> int:
        w = token.strip(EDGE)
        i = self.ids.get(w, 0) if w else -1
        if len(self) >= self.limit:
            self.clear()
        if len(token) <= 64:
            self[token] = i
        return i

    def of(self, text: str | None) -> np.ndarray:
        tokens = text.encode("utf-8", "replace").lower().split() if text else []
        a = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        return a[a >= 0]


def grams(ids: np.ndarray, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys of the n-grams whose words are all known."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    known = ids > 0
    ok = known[:m].copy()
    for k in range(1, n):
        ok &= known[k : k + m]
    at = np.flatnonzero(ok)
    key = np.zeros(len(at), dtype=np.int64)
    for k in range(n):
        key = key * base + ids[at + k]
    return at, key


class Items:
    """A block of test items, ready to be matched."""

    def __init__(self, rows: list[tuple[int, str]], p: Decon) -> None:
        self.p, self.ids, self.item_ids, self.words = p, {}, [], []
        short = []
        for item, text in rows:
            tokens = [w for t in (text or "").encode("utf-8", "replace").lower().split() if (w := t.strip(EDGE))]
            numbers = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in tokens], dtype=np.int64)
            if len(tokens) >= p.min_words:
                self.item_ids.append(item)
                self.words.append(numbers)
            elif tokens:
                short.append((item, numbers))
        self.base = len(self.ids) + 2
        #: (length of the key, key of an item's first words) -> short items
        self.short: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
        for item, numbers in short:
            n = min(len(numbers), p.gram)
            self.short.setdefault(n, {}).setdefault(int(grams(numbers[:n], n, self.base)[1][0]), []).append((item, numbers))
        if self.base**p.gram >= 1 << 62:
            raise ValueError("too many distinct words in one block of items; lower block_words")
        own = [grams(w, p.gram, self.base)[1] for w in self.words]
        self.keys = np.unique(np.concatenate(own)) if own else np.empty(0, np.int64)
        self.own = [np.searchsorted(self.keys, k) for k in own]
        self.cache: WordIds | None = None
        self.seeds: dict[int, list[tuple[int, int]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": None}

    def word_ids(self, text: str | None) -> np.ndarray:
        if self.cache is None:
            self.cache = WordIds(self.ids)
        return self.cache.of(text)

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and numbers of the document's n-grams that items have."""
        at, key = grams(ids, self.p.gram, self.base)
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[i] == key
        return at[hit], i[hit]

    def choose(self, frequency: np.ndarray) -> None:
        """The rarest n-gram of each run becomes a seed, those apart that no document has;
        ties go to the first."""
        self.seeds = {}
        for item, own in enumerate(self.own):
            f, chosen = np.where(frequency[own] > 0, frequency[own], np.iinfo(np.int64).max), set()
            for i in range(max(1, len(own) - self.p.spread + 1)):
                chosen.add(i + int(np.argmin(f[i : i + self.p.spread])))
            for i in chosen:
                self.seeds.setdefault(int(own[i]), []).append((item, i))

    def matches(self, text: str | None) -> list[tuple]:
        """(item_id, score, share, first word, last word, seeds) of each item found."""
        ids = self.word_ids(text)
        at, number = self.found(ids)
        by_item: dict[int, list[int]] = {}
        for pos, n in zip(at.tolist(), number.tolist()):
            for item, offset in self.seeds.get(n, ()):
                by_item.setdefault(item, []).append(pos - offset)
        out = []
        for item in sorted(by_item):
            words, starts = self.words[item], np.unique(by_item[item])
            best = None
            # Passages: starts closer than the item's length belong together.
            for group in np.split(starts, np.flatnonzero(np.diff(starts) > len(words)) + 1):
                lo = max(0, int(group[0]) - self.p.slack)
                hi = min(len(ids), int(group[-1]) + len(words) + self.p.slack)
                found = self.align(words, ids[lo:hi])
                if found is not None and (best is None or found[0] > best[0]):
                    best = (found[0], lo + found[1], lo + found[2])
            if best:
                out.append((self.item_ids[item], float(best[0]), float(best[0] / len(words)), best[1], best[2], len(by_item[item])))
        return out + self.equal(ids)

    def equal(self, ids: np.ndarray) -> list[tuple]:
        """Short items that stand in the text whole, at their first place."""
        out = {}
        for n, table in self.short.items():
            at, key = grams(ids, n, self.base)
            hit = np.flatnonzero(np.isin(key, np.fromiter(table, dtype=np.int64, count=len(table))))
            for pos, k in zip(at[hit].tolist(), key[hit].tolist()):
                for item, words in table[k]:
                    if item not in out and np.array_equal(ids[pos : pos + len(words)], words):
                        out[item] = (item, float(len(words)), 1.0, pos, pos + len(words), 1)
        return [out[i] for i in sorted(out)]

    def align(self, item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int] | None:
        """Local alignment score, if it is enough, with the aligned words of the passage: the
        first one and the one behind the last; else None."""
        p = self.p
        enough = min(p.share * len(item), p.run)
        (iw, ic), (pw, pc) = np.unique(item, return_counts=True), np.unique(passage, return_counts=True)
        _, i, j = np.intersect1d(iw, pw, assume_unique=True, return_indices=True)
        shared = int(np.minimum(ic[i], pc[j]).sum())  # no alignment matches more words
        if shared < enough:
            return None
        best, i, end = self._local(item, passage)
        if best < enough - 1e-9:
            return None
        # Backwards from the end of the best alignment its score is reached at its beginning.
        _, _, back = self._local(item[:i][::-1], passage[:end][::-1])
        return best, end - back, end

    def _local(self, item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
        """Best score of a local alignment, and how many words of item and passage lie before
        its end (the first such end)."""
        gap = self.p.penalty * np.arange(len(passage) + 1)
        row, best = np.zeros(len(passage) + 1), (0.0, 0, 0)
        for i, w in enumerate(item.tolist(), 1):
            new = np.maximum(row[:-1] + np.where(passage == w, 1.0, -self.p.penalty), row[1:] - self.p.penalty)
            new = np.maximum(np.concatenate([[0.0], new]), 0.0)
            row = np.maximum.accumulate(new + gap) - gap  # gaps in the passage
            j = int(row.argmax())
            if row[j] > best[0] + 1e-9:
                best = (float(row[j]), i, j)
        return best


_HITS = "array<struct<item_id:long,score:double,share:double,first_word:int,last_word:int,n_seeds:int>>"


def blocks(benchmark: DataFrame, p: Decon) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_words`` words at most; null ids or texts are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(chars // (4 * p.block_words)) + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = items.where(part == k).distinct().orderBy("item_id", "text").collect()  # at most a block
        if rows:
            yield [(r["item_id"], r["text"]) for r in rows]


def prepared(docs: DataFrame, benchmark: DataFrame, p: Decon = Decon()) -> list[Items]:
    """Items with seeds chosen by their n-grams' counts over all documents."""
    spark, out = docs.sparkSession, []
    for rows in blocks(benchmark, p):
        items = Items(rows, p)
        shared = spark.sparkContext.broadcast(items)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            block = shared.value
            total = np.zeros(len(block.keys), dtype=np.int64)
            for pdf in batches:
                for text in pdf["text"]:
                    total[np.unique(block.found(block.word_ids(text))[1])] += 1
            at = np.flatnonzero(total)
            yield pd.DataFrame({"i": at, "n": total[at]})

        frequency = np.zeros(len(items.keys), dtype=np.int64)
        for r in docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # at most the block's n-grams
            frequency[r["i"]] = r["n"]
        items.choose(frequency)
        out.append(items)
    return out


def hits_column(spark, items: Items):
    """A function Column -> array of matches of whole texts with one block of items."""
    shared = spark.sparkContext.broadcast(items)

    @F.pandas_udf(_HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("item_id", "score", "share", "first_word", "last_word", "n_seeds")
        for texts in batches:
            yield pd.Series([[dict(zip(names, m)) for m in shared.value.matches(t)] for t in texts], dtype=object)

    return find


def leaks(docs: DataFrame, benchmark: DataFrame, p: Decon = Decon()) -> DataFrame:
    """One row for each document row and test item found in it: doc_id, item_id, score
    (words), share (of the item), first_word and last_word (the aligned words: number of the
    first one, and of the one behind the last, among words with more than signs), n_seeds.

    Null or empty texts match nothing; repeated documents give repeated rows, repeated items
    count once; an empty benchmark gives no rows."""
    out = None
    for items in prepared(docs, benchmark, p):
        hits = docs.select("doc_id", F.explode(hits_column(docs.sparkSession, items)(F.col("text").cast("string"))).alias("h")).select("doc_id", "h.*")
        out = hits if out is None else out.unionAll(hits)
    if out is None:
        out = docs.select("doc_id", F.explode(F.expr(f"cast(array() as {_HITS})")).alias("h")).select("doc_id", "h.*")
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, p: Decon = Decon()) -> DataFrame:
    """The documents in which no test item is found, with their columns."""
    out = docs
    for items in prepared(docs, benchmark, p):
        out = out.where(F.size(hits_column(docs.sparkSession, items)(F.col("text").cast("string"))) == 0)
    return out
