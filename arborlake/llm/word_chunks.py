"""A corpus as chunks of numbered words, and counts of pairs of words that come back to them.

1. ``encode`` reads every text once.  A chunk holds the words of about ``tokens`` tokens (or
   of one longer text): its distinct words, numbered as they come, the learned count of each,
   and the texts as numbers.  Later passes read numbers, not texts.
2. ``requests``: each chunk sends its distinct pairs (word before, word) with their learned
   counts to buckets by the hash of the word before; pairs whose first word is ``hot`` are
   dealt by the hash of both.  A chunk sends a pair once, however often it holds it.
3. ``responses``: a bucket adds up the counts and gives every chunk, pair by pair in the
   chunk's own order, what all chunks have learned of it, and how many words have been learned
   after the first one.  For hot words each bucket tells its part, and the parts are added.

What one task holds is one chunk, or about one bucket of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.textkit import fold_words, mix64
from arborlake.plans.stage import trim

END = b"\n"  # white space, so never a word: the end of a text, and what stands before its first word
END_HASH = xxhash.xxh64_intdigest(END)

CHUNK = "chunk long, words array<binary>, n array<long>, ids binary, size long, doc_ids array<long>, no_id array<boolean>, lens array<long>, learn array<boolean>"
REQUEST = "bucket int, chunk long, ask boolean, pairs int, firsts int, u binary, runs binary, w binary, c binary"
RESPONSE = "chunk long, bucket int, pairs int, firsts int, c binary, kinds binary"
#: What a bucket has learned, for sampling: contexts (u, with how many dishes each), the dishes' words and customers,
#: words that stand once in a context by context (single) and by word (s_w, s_n), tables of each context so far.
DISHES = ", u binary, runs binary, w binary, single binary, singles int, s_w binary, s_n binary, tables binary"


def pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def unpack(b: bytes, n: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(b, n * kind.itemsize, codec="zstd", asbytes=True), dtype=kind) if n else np.zeros(0, dtype=kind)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def encode(docs: DataFrame, learned: Callable[[str], bool], tokens: int, words: int) -> DataFrame:
    """Chunks of all rows of (doc_id, text).  ``learned`` decides by the id as text (null: the
    empty string).  A text ends with END, which is number 0; null text: END alone.  A chunk
    ends when it holds ``tokens`` tokens or ``words`` distinct words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), 0
        index, ids, doc_ids, no_id, lens, learn, total = _Numbers({END: 0}), [], [], [], [], [], 0

        def out() -> pd.DataFrame:
            flat = np.concatenate(ids)
            n = np.bincount(flat[np.repeat(learn, lens)], minlength=len(index))
            row = (part << 24) + made, list(index), n, pack(flat), len(flat), doc_ids, no_id, lens, learn
            return pd.DataFrame([row], columns=[c.split()[0] for c in CHUNK.split(", ")])

        for pdf in batches:
            for doc, name, text in zip(pdf["doc_id"], pdf["name"], pdf["text"]):
                found = fold_words(text)
                found.append(END)
                ids.append(np.fromiter(map(index.__getitem__, found), dtype=np.uint32, count=len(found)))
                doc_ids.append(doc), no_id.append(not name), lens.append(len(found)), learn.append(learned(name))
                total += len(found)
                if total >= tokens or len(index) >= words:
                    yield out()
                    made += 1
                    index, ids, doc_ids, no_id, lens, learn, total = _Numbers({END: 0}), [], [], [], [], [], 0
        if ids:
            yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, CHUNK)


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, c): every word of every text with its learned count, END among them."""
    return chunks.select(F.inline(F.arrays_zip("words", "n"))).groupBy(F.col("words").alias("word")).agg(F.sum("n").alias("c"))


def hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in a sorted table, -1 if it is not there."""
    if not len(table):
        return np.full(len(x), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def before(flat: np.ndarray) -> np.ndarray:
    """The number before each one; texts end with 0, so 0 stands before each."""
    return np.concatenate([np.zeros(1, flat.dtype), flat[:-1]])


class Pairs:
    """A chunk's distinct pairs of numbers, by bucket and in it by first number: ``u``, ``w``,
    the runs of one first number (``start``, ``length``) and ``cuts``: (bucket, first and last
    pair, first and last run).  ``tokens``: the pair of each token, if asked for."""

    def __init__(self, flat: np.ndarray, h: np.ndarray, hot: np.ndarray, buckets: int, tokens: bool = False) -> None:
        code = before(flat).astype(np.int64) * len(h) + flat
        if tokens:
            by = np.argsort(code)
            code = code[by]
        else:
            code = np.sort(code)
        new = np.append(True, code[1:] != code[:-1])
        code = code[new]
        u, w = (x.astype(np.uint32) for x in np.divmod(code, len(h)))
        del code
        place = mix64(h[u])
        is_hot = (find(hot, h) >= 0)[u]
        place[is_hot] = mix64(place[is_hot] + h[w[is_hot]])
        bucket = ((place >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 65536 else np.int64)
        order = np.argsort(bucket, kind="stable")
        self.u, self.w, bucket = u[order], w[order], bucket[order]
        del u, w, place, is_hot
        change = np.append(True, (self.u[1:] != self.u[:-1]) | (bucket[1:] != bucket[:-1]))
        self.start = np.flatnonzero(change)
        self.length = np.diff(np.append(self.start, len(self.u)))
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        run = np.searchsorted(self.start, edge)
        self.cuts = [(int(bucket[a]), a, b, c, d) for a, b, c, d in zip(edge[:-1].tolist(), edge[1:].tolist(), run[:-1].tolist(), run[1:].tolist())]
        if tokens:
            at = np.empty(len(order), dtype=np.uint32)
            at[order] = np.arange(len(order), dtype=np.uint32)
            self.tokens = np.empty(len(flat), dtype=np.uint32)
            self.tokens[by] = at[np.cumsum(new, dtype=np.uint32) - 1]


def _learned_counts(flat: np.ndarray, learn: np.ndarray, pairs: Pairs, n: int) -> np.ndarray:
    """How often the chunk's learned texts hold each pair."""
    code = np.sort((before(flat).astype(np.int64) * n + flat)[learn])
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    at = find(code[first], pairs.u.astype(np.int64) * n + pairs.w)
    return np.where(at >= 0, np.diff(np.append(first, len(code)))[at], 0).astype(np.int32) if len(first) else np.zeros(len(pairs.u), np.int32)


def requests(chunks: DataFrame, hot: np.ndarray, buckets: int, ask: bool = True) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                flat, h = unpack(r.ids, r.size, np.uint32), hashes(r.words)
                if not ask:  # learned texts alone
                    keep = np.repeat(np.asarray(r.learn, bool), r.lens)
                    flat = flat[keep]
                if not len(flat):
                    continue
                p = Pairs(flat, h, hot, buckets)
                c = _learned_counts(flat, np.repeat(np.asarray(r.learn, bool), r.lens) if ask else np.ones(len(flat), bool), p, len(h))
                w, u = h[p.w], h[p.u[p.start]]
                rows = [(k, r.chunk, ask, b - a, d - e, pack(u[e:d]), pack(p.length[e:d].astype(np.uint32)), w[a:b].tobytes(), pack(c[a:b])) for k, a, b, e, d in p.cuts]
                del flat, h, p, c, w, u
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in REQUEST.split(", ")])
                del rows
                trim()

    return chunks.select("chunk", "words", "ids", "size", "lens", "learn").mapInPandas(run, REQUEST)


def responses(asked: DataFrame, hot: np.ndarray, dishes: bool = False) -> DataFrame:
    """One row for each request of an asking chunk, and one with chunk -1 for each bucket that
    holds hot words: their hashes (``c``) and numbers of words after them (``kinds``).  With
    ``dishes`` also one with chunk -2 for each bucket (DISHES): pairs learned more than once,
    by context; hot contexts stand in every bucket that has learned a pair of theirs."""

    def learned(words: np.ndarray, is_hot: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple:
        many, at = c > 1, np.searchsorted(words, u)
        n, single = np.bincount(at[many], minlength=len(words)), np.bincount(at[c == 1], minlength=len(words))
        keep = (n > 0) | (is_hot & (n + single > 0))
        by = np.argsort(at[many], kind="stable")
        s_w, s_n = np.unique(w[c == 1], return_counts=True)
        runs, single = n[keep].astype(np.uint32), single[keep].astype(np.uint32)
        return int(many.sum()), len(runs), pack(c[many][by].astype(np.int32)), b"", words[keep].tobytes(), pack(runs), w[many][by].tobytes(), pack(single), len(s_w), s_w.tobytes(), pack(s_n.astype(np.uint32)), (runs + single).tobytes()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk", kind="stable")
        firsts = [unpack(b, n, np.uint64) for b, n in zip(g["u"], g["firsts"])]
        runs = [unpack(b, n, np.uint32) for b, n in zip(g["runs"], g["firsts"])]
        u1, u = np.concatenate(firsts), np.concatenate([np.repeat(a, b) for a, b in zip(firsts, runs)])
        w = np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in g["w"]])
        c = np.concatenate([unpack(b, n, np.int32) for b, n in zip(g["c"], g["pairs"])])
        _, first, pair = np.unique(mix64(mix64(u + np.uint64(0x9E3779B97F4A7C15)) + w), return_index=True, return_inverse=True)
        in_all = total = np.bincount(pair, c).astype(np.int64)
        words, back = np.unique(u1, return_inverse=True)
        kinds = np.bincount(np.searchsorted(words, u[first[total > 0]]), minlength=len(words))
        total, kind_of = total[pair].astype(np.uint32), kinds[back].astype(np.uint32)
        out, i, j = [], 0, 0
        for chunk, ask, bucket, n, m in zip(g["chunk"], g["ask"], g["bucket"], g["pairs"], g["firsts"]):
            if ask:
                out.append((chunk, bucket, n, m, pack(total[i : i + n]), pack(kind_of[j : j + m])))
            i, j = i + n, j + m
        is_hot = find(hot, words) >= 0
        if is_hot.any():
            out.append((-1, g["bucket"].iloc[0], 0, int(is_hot.sum()), pack(words[is_hot]), pack(kinds[is_hot].astype(np.uint32))))
        if dishes:
            out = [(*row, *[None] * DISHES.count(", ")) for row in out]
            out.append((-2, g["bucket"].iloc[0], *learned(words, is_hot, u[first], w[first], in_all)))
        del u1, u, w, c, first, pair, in_all, total, kind_of, back
        trim()
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    schema = RESPONSE + DISHES * dishes
    return asked.groupBy("bucket").applyInPandas(run, schema)


def hot_kinds(answers: DataFrame, hot: np.ndarray) -> np.ndarray:
    """The number of different words learned after each hot word."""
    out = np.zeros(len(hot), dtype=np.int64)
    for r in answers.where("chunk = -1").select("firsts", "c", "kinds").toLocalIterator():  # hot words of a bucket
        at = find(hot, unpack(r["c"], r["firsts"], np.uint64))
        out[at] += unpack(r["kinds"], r["firsts"], np.uint32)
    return out
