"""Language-model scores by a hierarchical Pitman-Yor model.

Words are drawn from a Pitman-Yor restaurant whose base measure spells them: letter
restaurants, one for each context of up to three preceding bytes, each sharing the parent of
its shortened context, down to the uniform distribution.  Unknown words thus get the
probability of their spelling, and the whole is a proper distribution over texts.

Every word is in turn the context of the next one: each context has a restaurant of its own
that shares the word restaurant as its parent, and the end of a text is the context of the
first word.  With c customers and t tables of a word, C and T in all,
P(w | u) = (c - d t + (strength + d T) P(w)) / (strength + C).

With ``seat_contexts`` the tables of contexts are sampled like all others: in each sweep the
customers of every (context, word) are seated anew at the word's probability in the word
restaurant, and each of their tables is one customer there.  A word met once in a context has
one table, so only pairs met more than once are kept and seated, in buckets by the hash of the
context.  Seats follow from the hash of (context, word, sweep), so a chunk that knows the count
of a pair, the context's tables and the word's probability seats it as its bucket did.
Without it, a context holds one table for each word (the seating by which interpolated
Kneser-Ney approximates the model) and the word restaurant keeps every occurrence.

Gibbs sampling: given the spelling model, every word's customers are seated anew (a customer
opens a table with probability proportional to (strength + discount * tables) * spelling);
each table sends one draw of the word to the letter restaurants, whose customers are then
seated level by level.  After one sweep of burn-in, ``samples`` sweeps are kept and their
predictive probabilities averaged.

What grows with the corpus stays distributed.  The texts are encoded once as chunks of
numbered words (``word_chunks``); the word table is a DataFrame, sampled in place; counts of
pairs are added up in buckets by the hash of the context, and each chunk gets back the counts
of its own pairs.  Words learned or not are looked up in two ways with the same result: the
``head`` most frequent ones are broadcast (at most so many), those of the others that a chunk
holds are joined to it.  The letter model is bounded by ``classes``^3 * 256 entries, as
contexts know the most frequent bytes apart and all others together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.textkit import mix64
from arborlake.llm.word_chunks import END, Pairs, encode, find, hashes, hot_kinds, pack, requests, responses, unpack, word_counts
from arborlake.plans.stage import discard, materialise, release, trim

_NL = 10  # white space, so never a byte of a word: ends a word and stands before it
_GAP = b"\n\n\n"


@dataclass(frozen=True)
class PitmanYor:
    """``head``: words broadcast for scoring.  ``tokens``, ``words``: tokens or distinct words
    that make a chunk, which one task holds.  Discounts of words follow from the counts of
    counts.  ``bucket``: about so many pairs meet in one task; a context with more than an
    eighth of that, and with more than one in ``hot`` of all tokens, is a hot one, dealt to all
    buckets."""

    classes: int = 40
    samples: int = 2
    burn_in: int = 1
    strength: float = 1.0
    letter_discount: float = 0.5
    letter_strength: float = 1.0
    head: int = 1_000_000
    tokens: int = 2_000_000
    words: int = 300_000
    context_discount: float = 0.7
    context_strength: float = 1.0
    bucket: int = 2_000_000
    hot: int = 100_000
    seat_contexts: bool = False


def poisson(lam: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson numbers from uniform ones: by inversion, above 30 by the normal tail."""
    out = np.zeros(len(lam), dtype=np.int64)
    small = lam <= 30
    l, v = lam[small], u[small]
    p = np.exp(-l)
    cdf, k = p.copy(), np.zeros(len(l), dtype=np.int64)
    for i in range(1, 120):
        more = v > cdf
        if not more.any():
            break
        k[more] += 1
        p = p * l / i
        cdf += p
    out[small] = k
    if (~small).any():
        w = np.clip(u[~small], 1e-9, 1 - 1e-9)
        z = np.log(w / (1 - w)) / 1.702  # logistic in place of the normal quantile
        out[~small] = np.maximum(np.rint(lam[~small] + np.sqrt(lam[~small]) * z), 0).astype(np.int64)
    return out


def seat(c: np.ndarray, rate: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """Tables of dishes with c customers each, seated one after the other: the k-th opens a
    table with probability rate / (rate + k - d t).  The first 32 one by one, later ones in
    doubling blocks with Poisson many openings.  ``key`` (uint64) seeds each dish."""
    t = (c > 0).astype(np.int64)
    step = 0

    def uniform(at: np.ndarray) -> np.ndarray:
        salt = np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return (mix64(key[at] + salt) >> np.uint64(11)) / float(1 << 53)

    at = np.flatnonzero(c > 1)
    k = 1
    while len(at):
        if k < 32:
            new = uniform(at) < rate[at] / (rate[at] + k - d * t[at])
            t[at] += new
            k += 1
        else:
            end = np.minimum(c[at], 2 * k)
            lam = rate[at] * np.log((rate[at] + end - d * t[at]) / (rate[at] + k - d * t[at]))
            t[at] += np.minimum(poisson(np.maximum(lam, 0), uniform(at)), end - k)
            k *= 2
        step += 1
        at = at[c[at] > k]
    return t


class Spelling:
    """P(byte | up to 3 bytes before): levels[k] = (weights of the dishes, weight of the parent)."""

    def __init__(self, cls: np.ndarray, n: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.cls, self.n, self.levels = cls, n, levels
        self.dense: list[tuple[np.ndarray, np.ndarray]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None}

    def _open(self) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.dense is None:
            self.dense = []
            for k, (at, w, up) in enumerate(self.levels):
                a = np.zeros(self.n**k * 256, dtype=np.float32)
                a[at] = w
                self.dense.append((a, up))
        return self.dense

    def prob(self, contexts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        p = np.full(len(x), 1 / 256)
        for (a, up), ctx in zip(self._open(), contexts):
            p = a[ctx * 256 + x] + up[ctx] * p
        return p

    def log_words(self, words: list[bytes], block: int = 1 << 20) -> np.ndarray:
        """Natural log of each word's spelling, its end included; by blocks of about so many
        bytes."""
        out, i = np.zeros(len(words)), 0
        while i < len(words):
            j, n = i, 0
            while j < len(words) and (n == 0 or n + len(words[j]) <= block):
                n += len(words[j]) + 3
                j += 1
            contexts, x, first = _stream(words[i:j], self.cls, self.n)
            out[i:j] = np.add.reduceat(np.log(self.prob(contexts, x)), first)
            i = j
        return out

    def end_of_text(self) -> float:
        """P(a word ends before its first byte): the end of the text.  Without dense tables."""
        b, prob = int(self.cls[_NL]), 1 / 256
        for (at, w, up), ctx in zip(self.levels, (0, b, b * self.n + b, (b * self.n + b) * self.n + b)):
            i = int(np.searchsorted(at, ctx * 256 + _NL))
            prob = (float(w[i]) if i < len(at) and at[i] == ctx * 256 + _NL else 0.0) + float(up[ctx]) * prob
        return prob


def _stream(words: list[bytes], cls: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For all bytes of non-empty words and their ends: contexts of length 0 to 3, the byte,
    and where each word begins."""
    buf = np.frombuffer(_GAP + _GAP.join(words) + _GAP, dtype=np.uint8)
    c = cls[buf]
    pos = np.flatnonzero((buf[3:] != _NL) | (buf[2:-1] != _NL)) + 3
    one, two, three = c[pos - 1], c[pos - 2], c[pos - 3]
    ends = buf[pos] == _NL
    first = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    return [np.zeros(len(pos), dtype=np.int64), one, two * n + one, (three * n + two) * n + one], buf[pos].astype(np.int64), first


def learn_spelling(keys: np.ndarray, counts: np.ndarray, cls: np.ndarray, p: PitmanYor, sweep: int) -> Spelling:
    """keys: context of three classes * 256 + byte; counts: customers.  Seats each level from
    the longest contexts up, tables becoming the parent's customers; parents' probabilities
    while seating are those of the customers' shares, then every level is estimated from the
    root down."""
    n, d, theta = p.classes, p.letter_discount, p.letter_strength
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [None] * 4  # type: ignore[list-item]
    order = np.argsort(keys, kind="stable")
    at, c = keys[order].astype(np.int64), counts[order].astype(np.int64)
    for k in (3, 2, 1, 0):
        size = n**k
        ctx, x = at // 256, at % 256
        total = np.bincount(ctx, c, size)
        kinds = np.bincount(ctx, minlength=size)
        if k:
            up = (ctx % n ** (k - 1)) * 256 + x
            parent, inv = np.unique(up, return_inverse=True)
            share = np.bincount(inv, np.minimum(c, 1))
            base = share[inv] / np.bincount(parent // 256, share, n ** (k - 1))[up // 256]
            t = seat(c, (theta + d * kinds[ctx]) * base, d, mix64(at.astype(np.uint64) + np.uint64(1 + sweep * 8 + k)))
        else:
            t = seat(c, (theta + d * kinds[ctx]) / 256, d, mix64(at.astype(np.uint64) + np.uint64(1 + sweep * 8)))
        tables = np.bincount(ctx, t, size)
        levels[k] = (at, ((c - d * t) / (theta + total[ctx])).astype(np.float32), ((theta + d * tables) / (theta + total)).astype(np.float32))
        if k:
            at, c = parent, np.bincount(inv, t).astype(np.int64)
    return Spelling(cls, n, levels)


def _letters(cls: np.ndarray, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            contexts, x, first = _stream(pdf["word"].tolist(), cls, n)
            reps = np.repeat(pdf["t"].to_numpy(np.int64), np.diff(np.append(first, len(x))))
            key, inv = np.unique(contexts[3] * 256 + x, return_inverse=True)
            yield pd.DataFrame({"k": key, "n": np.bincount(inv, reps).astype(np.int64)})

    return run


@dataclass
class Model:
    """``words``: DataFrame (word, h, c, lp) with h the word's hash and lp the natural log of the
    averaged predictive probability; the end of a text apart.  ``chunks``: the texts learned
    from, encoded."""

    params: PitmanYor
    words: DataFrame
    n: int
    v: int
    c_end: int
    lp_end: float
    lp_unknown: float
    discount: float
    docs: DataFrame
    chunks: DataFrame
    states: Seats | None = None


@dataclass
class Seats:
    """Sampled contexts: states from the last of burn-in on, the first only seats the next one's
    pairs (p0 is null for words met once).  ``unknown``: probability of all words not learned
    (but for the first), ``end`` and ``end_tables``: of the end and of the context that it is,
    by state.  ``words`` has p0, p1, ... and t0, t1, ...  ``hot``, ``buckets``, ``answers``:
    pairs of the learned chunks, counted."""

    unknown: np.ndarray
    end: np.ndarray
    end_tables: np.ndarray
    hot: np.ndarray
    buckets: int
    answers: DataFrame


def fit(docs: DataFrame, modulus: int, remainder: int, p: PitmanYor = PitmanYor()) -> Model:
    """Learn from all rows of (doc_id, text) whose crc32(doc_id as text) mod ``modulus`` is
    not ``remainder``; the other rows' words are listed with c = 0, so that they get a
    probability.  Null id: the empty text."""
    import zlib

    spark = docs.sparkSession
    chunks = materialise(encode(docs, lambda name: zlib.crc32(name.encode()) % modulus != remainder, p.tokens, p.words), "py_chunks")
    words = materialise(word_counts(chunks), "py_words")
    first = words.where(F.col("word") == F.lit(END)).select("c").first()
    c_end = first["c"] if first else 0
    every, words = words, words.where(F.col("word") != F.lit(END))
    s = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    n, v = (s["n"] or 0) + c_end, s["v"] + (c_end > 0)
    d = min(0.95, max(0.05, s["n1"] / max(1, s["n1"] + 2 * s["n2"])))

    # Byte classes: the most frequent bytes in the words' types, then one class for the rest.
    def bytes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256, dtype=np.int64)
        for pdf in batches:
            total += np.bincount(np.frombuffer(b"".join(pdf["word"]), dtype=np.uint8), minlength=256)
        yield pd.DataFrame({"b": np.arange(256), "n": total})

    freq = np.zeros(256, dtype=np.int64)
    for r in words.where("c > 0").select("word").mapInPandas(bytes_of, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # 256 rows
        freq[r["b"]] = r["n"]
    cls = np.full(256, p.classes - 1, dtype=np.int64)
    cls[_NL] = 0
    top = [b for b in np.argsort(-freq, kind="stable") if b != _NL][: p.classes - 2]
    cls[top] = np.arange(1, len(top) + 1)

    def spelling(table: DataFrame, t_end: int, sweep: int) -> Spelling:
        got = table.where("t > 0").select("word", "t").mapInPandas(_letters(cls, p.classes), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        b = int(cls[_NL])
        end = ((b * p.classes + b) * p.classes + b) * 256 + _NL
        keys, counts = got["k"].to_numpy().astype(np.int64), got["n"].to_numpy().astype(np.int64)
        return learn_spelling(np.append(keys, end), np.append(counts, max(t_end, 1)), cls, p, sweep)

    if p.seat_contexts:
        model = _sample_contexts(docs, chunks, words, n, v, c_end, p, spelling)
        discard(every)
        return model

    def sweep_words(shared, tables: float, number: int, keep: bool, again: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                word, c, t = pdf["word"].tolist(), pdf["c"].to_numpy(np.int64), pdf["t"].to_numpy(np.int64)
                h = np.exp(np.maximum(m.log_words(word), -690.0))
                acc = pdf["acc"].to_numpy(np.float64)
                if keep:
                    acc = acc + (c - d * t + (p.strength + d * tables) * h) / (p.strength + n)
                if again:
                    key = np.fromiter((xxhash.xxh64_intdigest(w, seed=number) for w in word), dtype=np.uint64, count=len(word))
                    t = seat(c, (p.strength + d * tables) * h, d, key)
                yield pd.DataFrame({"word": word, "h": pdf["h"] if number else hashes(word).view(np.int64), "c": c, "t": t, "acc": acc})

        return run

    table = words.select("word", F.lit(0).cast("long").alias("h"), "c", (F.col("c") > 0).cast("long").alias("t"), F.lit(0.0).alias("acc"))
    t_end, acc_end, tables = int(c_end > 0), 0.0, float(v)
    last = p.burn_in + p.samples
    for number in range(last + 1):
        model = spelling(table, t_end, number)
        keep, again = number > p.burn_in, number < last
        h_end = model.end_of_text()
        if keep:
            acc_end += (c_end - d * t_end + (p.strength + d * tables) * h_end) / (p.strength + n)
        if again:
            t_end = int(seat(np.array([c_end]), np.array([(p.strength + d * tables) * h_end]), d, np.array([number + 1], dtype=np.uint64))[0])
        shared = spark.sparkContext.broadcast(model)
        old, table = table, materialise(table.mapInPandas(sweep_words(shared, tables, number, keep, again), "word binary, h long, c long, t long, acc double"), "py_sweep")
        shared.destroy()  # the table is written
        discard(old)
        if again:
            tables = float((table.agg(F.sum("t")).first()[0] or 0) + t_end)
    lp = F.log(F.greatest(F.col("acc") / p.samples, F.lit(1e-300)))
    p_end = max(acc_end / p.samples, 1e-300)
    known = (table.where("c > 0").agg(F.sum(F.col("acc") / p.samples)).first()[0] or 0.0) + (p_end if c_end else 0.0)
    return Model(p, table.select("word", "h", "c", lp.alias("lp")), n, v, c_end, float(np.log(p_end)), float(np.log(max(1 - known, 1e-300))), d, docs, chunks)


def _dealt(words: DataFrame, n: int, p: PitmanYor) -> tuple[np.ndarray, int]:
    """Hashes of hot contexts, the end among them, and the number of buckets.  Hot ones are
    dealt to all buckets: those that would fill an eighth of one."""
    hot = [r["word"] for r in words.where(F.col("c") > max(p.bucket // 8, n // p.hot)).select("word").toLocalIterator()]  # at most ``hot``
    return np.sort(hashes([*hot, END])), max(12, -(-n // p.bucket))


def _in_head(words: DataFrame, p: PitmanYor):
    """Condition for the head, from counts by eighths of an octave, at most 512 of them."""
    octave = F.floor(F.log2("c") * 8).cast("int")
    hist = sorted(((r["o"], r["n"]) for r in words.where("c > 0").groupBy(octave.alias("o")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for o, k in hist:
        if total + k > p.head:
            break
        total, least = total + k, o
    return F.coalesce((F.col("c") > 0) & (octave >= least), F.lit(False)) if least is not None else F.lit(False)


def seat_pairs(c: np.ndarray, tables: np.ndarray, prob: np.ndarray, u: np.ndarray, w: np.ndarray, sweep: int, p: PitmanYor) -> np.ndarray:
    """Tables of pairs (hashes u, w) with c customers, from the contexts' tables and the words'
    probabilities before the sweep."""
    t = np.minimum(c, 1)
    at = np.flatnonzero(c > 1)
    key = mix64(mix64(u[at] + np.uint64(0x9E3779B97F4A7C15 * (sweep + 1) % (1 << 64))) + w[at])
    t[at] = seat(c[at], (p.context_strength + p.context_discount * tables[at]) * prob[at], p.context_discount, key)
    return t


_STATE = "bucket int, pairs int, firsts int, c binary, u binary, runs binary, w binary, single binary, tables binary, sums int, sum_w binary, sum_t binary"


def _sample_contexts(docs: DataFrame, chunks: DataFrame, words: DataFrame, n: int, v: int, c_end: int, p: PitmanYor, spelling) -> Model:
    """The sweeps with sampled contexts.  A state: tables of pairs, of contexts and of words."""
    spark = docs.sparkSession
    hot, buckets = _dealt(words, n, p)
    answers = materialise(responses(requests(chunks, hot, buckets), hot, dishes=True), "py_answers")
    release(spark, 0)
    end = int(hashes([END]).view(np.int64)[0])

    def customers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                w, k = np.unique(np.frombuffer(r.w, np.uint64), return_counts=True)
                yield pd.DataFrame({"h": np.frombuffer(r.s_w, np.int64), "single": unpack(r.s_n, r.singles, np.uint32), "more": 0})
                yield pd.DataFrame({"h": w.view(np.int64), "single": 0, "more": k})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": pdf["word"], "h": hashes(pdf["word"]).view(np.int64), "c": pdf["c"]})

    learned = answers.where("chunk = -2")
    first = learned.select("w", "singles", "s_w", "s_n").mapInPandas(customers, "h long, single long, more long").groupBy("h").agg(F.sum("single").alias("single"), F.sum("more").alias("more"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    table = words.mapInPandas(hashed, "word binary, h long, c long").join(first, "h", "left")
    table = materialise(table.select("word", "h", "c", zero("single").alias("single"), (zero("single") + zero("more")).alias("k"), F.least(zero("single") + zero("more"), F.lit(1).cast("long")).alias("t")), "py_sweep")
    of_end = first.where(F.col("h") == end).first()
    single_end, k_end = (of_end["single"], of_end["single"] + of_end["more"]) if of_end else (0, 0)
    s = table.agg(F.sum("k").alias("k"), F.sum("t").alias("t"), F.count_if(F.col("k") == 1).alias("n1"), F.count_if(F.col("k") == 2).alias("n2")).first()
    d = min(0.95, max(0.05, s["n1"] / max(1, s["n1"] + 2 * s["n2"])))
    t_end, total, tables = min(k_end, 1), float((s["k"] or 0) + k_end), float((s["t"] or 0) + min(k_end, 1))
    head, p_end = _in_head(words, p), []
    tail_words = not table.where(~head & (F.col("c") > 1)).isEmpty()
    state = learned.select("bucket", "pairs", "firsts", "c", "u", "runs", "w", "single", "tables", F.lit(0).alias("sums"), F.lit(b"").alias("sum_w"), F.lit(b"").alias("sum_t"))

    def predict(shared, total: float, tables: float, ended: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                h = np.exp(np.maximum(m.log_words(pdf["word"].tolist()), -690.0))
                prob = (pdf["k"] - d * pdf["t"] + (p.strength + d * tables) * h) / (p.strength + total)
                pdf = pdf.drop(columns=["k", "t"]).assign(p=prob, spelled=h)
                yield pdf.drop(columns=["single", "spelled"]) if ended else pdf
            trim()

        return run

    def seat_words(shared, tables: float, number: int):
        """Words without a dish take no customers from ``more``, the dishes' tables."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                h, k = pdf["h"].to_numpy(np.int64), pdf["single"].to_numpy(np.int64)
                if shared is not None:
                    at = find(shared.value[0], h)
                    more = np.where(at >= 0, shared.value[1][at], 0) if len(shared.value[0]) else 0
                else:
                    more = pdf.pop("more").fillna(0).to_numpy(np.int64)
                k = k + more
                t = seat(k, (p.strength + d * tables) * pdf["spelled"].to_numpy(), d, mix64(h.view(np.uint64) + np.uint64(number + 1)))
                pdf = pdf.drop(columns=["spelled"]).assign(k=k, t=t)
                if number == p.burn_in:  # asked for only where a pair may have been met twice
                    pdf["p0"] = pdf["p0"].where(pdf["c"] > 1)
                yield pdf
            trim()

        return run

    def others(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for bucket, w in zip(pdf["bucket"], pdf["w"]):
                    w = np.unique(np.frombuffer(w, np.uint64))
                    yield pd.DataFrame({"bucket": bucket, "h": w[find(shared.value[0], w) < 0].view(np.int64)})

        return run

    def seat_contexts(shared, number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, prob, hot_tables = shared.value
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    u, runs, w = np.frombuffer(r.u, np.uint64), unpack(r.runs, r.firsts, np.uint32), np.frombuffer(r.w, np.uint64)
                    before = np.frombuffer(r.tables, np.uint32)
                    at = find(hot, u)
                    now = np.where(at >= 0, hot_tables[at], before[len(before) - r.firsts :]).astype(np.float64)
                    at = find(known, w)
                    of = prob[at]
                    if r.t_h is not None and len(r.t_h):
                        more = np.asarray(r.t_h, dtype=np.int64).view(np.uint64)
                        by = np.argsort(more)
                        of = np.where(at >= 0, of, np.asarray(r.t_p, dtype=np.float64)[by][find(more[by], w)])
                    who = np.repeat(np.arange(r.firsts), runs)
                    t = seat_pairs(unpack(r.c, r.pairs, np.int32).astype(np.int64), now[who], of, u[who], w, number, p)
                    new = (unpack(r.single, r.firsts, np.uint32) + np.bincount(who, t, r.firsts)).astype(np.uint32)
                    words, inv = np.unique(w, return_inverse=True)
                    yield pd.DataFrame([(r.bucket, r.pairs, r.firsts, r.c, r.u, r.runs, r.w, r.single, r.tables + new.tobytes(), len(words), words.tobytes(), pack(np.bincount(inv, t, len(words)).astype(np.uint32)))], columns=[x.split()[0] for x in _STATE.split(", ")])
                    del u, runs, w, at, now, of, who, t, new, words, inv
                    trim()

        return run

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, w, t in zip(pdf["sums"], pdf["sum_w"], pdf["sum_t"]):
                yield pd.DataFrame({"h": np.frombuffer(w, np.int64), "more": unpack(t, k, np.uint32)})

    def contexts(only_hot: bool, begin: int):
        """h and tables by state, from state ``begin`` on."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for m, u, t in zip(pdf["firsts"], pdf["u"], pdf["tables"]):
                    u = np.frombuffer(u, np.uint64)
                    t = np.frombuffer(t, np.uint32).reshape(-1, m)[begin:] if m else np.zeros((0, 0))
                    keep = find(hot, u) >= 0 if only_hot else slice(None)
                    if m:
                        yield pd.DataFrame({"h": u[keep].view(np.int64)} | {f"t{i}": x[keep] for i, x in enumerate(t)})

        return run

    last = p.burn_in + p.samples
    for number in range(last + 1):
        model = spelling(table, t_end, number)
        p_end.append((k_end - d * t_end + (p.strength + d * tables) * model.end_of_text()) / (p.strength + total))
        shared = spark.sparkContext.broadcast(model)
        kept = [f"p{i}" for i in range(number - p.burn_in)]  # of the states before
        held = "word binary, h long, c long" + ", single long" * (number < last) + "".join(f", {x} double" for x in kept)
        columns = f"{held}, p double" + ", spelled double" * (number < last)
        old, table = table, materialise(table.mapInPandas(predict(shared, total, tables, number == last), columns), "py_sweep")
        shared.destroy()  # the table is written
        discard(old)
        if number == last:
            break
        top = table.where(head).select("h", "p").toArrow()
        h = np.append(top["h"].to_numpy().view(np.uint64), hashes([END]))
        by = np.argsort(h)
        got = {r["h"]: r["t0"] for r in state.select("firsts", "u", "tables").mapInPandas(contexts(True, number), "h long, t0 long").groupBy("h").agg(F.sum("t0").alias("t0")).toLocalIterator()}  # hot ones
        shared = spark.sparkContext.broadcast((h[by], np.append(top["p"].to_numpy(), p_end[-1])[by], np.array([got.get(x, 0) for x in hot.view(np.int64).tolist()], dtype=np.int64)))
        del top, h
        rows = state.withColumns({"t_h": F.lit(None).cast("array<long>"), "t_p": F.lit(None).cast("array<double>")})
        if tail_words:
            tail = state.select("bucket", "w").mapInPandas(others(shared), "bucket int, h long").join(table.select("h", "p"), "h")
            rows = state.join(tail.groupBy("bucket").agg(F.collect_list(F.struct("h", "p")).alias("t")).select("bucket", F.col("t.h").alias("t_h"), F.col("t.p").alias("t_p")), "bucket", "left")
        old, state = state, materialise(rows.select(*[x.split()[0] for x in _STATE.split(", ")], "t_h", "t_p").mapInPandas(seat_contexts(shared, number), _STATE), "py_state")
        shared.destroy()  # the table is written
        discard(old)
        more = state.select("sums", "sum_w", "sum_t").mapInPandas(sums, "h long, more long").groupBy("h").agg(F.sum("more").alias("more"))
        more = materialise(more, "py_more")
        rows, shared = table.select("word", "h", "c", "single", *kept, *[F.col("p").alias(f"p{number - p.burn_in}")] * (number >= p.burn_in), "spelled"), None
        held += f", p{number - p.burn_in} double" * (number >= p.burn_in)
        if more.count() <= p.head:
            got = more.toArrow()
            h = got["h"].to_numpy()
            by = np.argsort(h)
            shared = spark.sparkContext.broadcast((h[by], got["more"].to_numpy()[by]))
            del got, h
        else:
            rows = rows.join(more, "h", "left")
        old, table = table, materialise(rows.mapInPandas(seat_words(shared, tables, number), f"{held}, k long, t long"), "py_sweep")
        if shared is not None:
            shared.destroy()  # the table is written
        discard(old)
        of_end = more.where(F.col("h") == end).first()
        k_end = single_end + (of_end["more"] if of_end else 0)
        discard(more)
        t_end = int(seat(np.array([k_end]), np.array([(p.strength + d * tables) * model.end_of_text()]), d, np.array([number + 1], dtype=np.uint64))[0])
        s = table.agg(F.sum("k").alias("k"), F.sum("t").alias("t")).first()
        total, tables = float((s["k"] or 0) + k_end), float((s["t"] or 0) + t_end)

    # States from the last of burn-in on; a context of which no pair is kept has as many tables as customers.
    k, at = p.samples + 1, range(p.samples + 1)
    of_context = state.select("firsts", "u", "tables").mapInPandas(contexts(False, p.burn_in), "h long, " + ", ".join(f"t{i} long" for i in at)).groupBy("h").agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in at])
    of_context = materialise(of_context, "py_contexts")
    row = of_context.where(F.col("h") == end).first()
    table = table.withColumnRenamed("p", f"p{p.samples}")
    mean = sum([F.col(f"p{i}") for i in at[2:]], F.col("p1")) / p.samples
    out = table.join(of_context, "h", "left").select("word", "h", "c", F.log(F.greatest(mean, F.lit(1e-300))).alias("lp"), *[f"p{i}" for i in at], *[F.coalesce(f"t{i}", "c").alias(f"t{i}") for i in at])
    discard(state)
    known = table.where("c > 0").agg(F.lit(0.0).alias("p0"), *[F.sum(f"p{i}").alias(f"p{i}") for i in at[1:]]).first()
    ends = np.array(p_end[p.burn_in :]) if c_end else np.zeros(k)
    unknown = np.maximum(1 - np.array([x or 0.0 for x in known]) - ends, 1e-300)
    seats = Seats(unknown, np.maximum(p_end[p.burn_in :], 1e-300), np.array([row[f"t{i}"] if row else c_end for i in at], dtype=np.int64), hot, buckets, answers)
    return Model(p, out, n, v, c_end, float(np.log(seats.end[1:].mean())), float(np.log(unknown[1:].mean())), d, docs, chunks, seats)


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts in four bytes, if all fit."""
    return x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x.astype(np.int64)


def context_term(c, total, kinds, lp, p: PitmanYor) -> np.ndarray:
    """log P(w | u) - log P(w): c customers of w in u's restaurant, ``total`` and ``kinds``
    customers and tables there, lp = log P(w)."""
    d, theta = p.context_discount, p.context_strength
    return np.log((np.maximum(c - d, 0) * np.exp(-np.maximum(lp, -600.0)) + theta + d * kinds) / (theta + total))


_RESULT = "doc_id long, n_tokens long, n_known long, b double, s double, spelled double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_tokens, n_known, base_score, score,
    event_score, perplexity.  Null text: the end alone.

    ``score`` is the log10 probability of the text itself: each word in the context of the one
    before it, unseen words spelled out.  ``event_score`` is the same over the events that
    ``base_score`` knows: each known word, the end, and "a word not seen in training", whose
    probability is all that the model leaves to unseen words.  ``perplexity`` is by token,
    from ``score``."""
    spark, p = docs.sparkSession, model.params
    own = docs is model.docs  # learned and scored in one go
    chunks = model.chunks if own else materialise(encode(docs, lambda name: False, p.tokens, p.words), "py_asked")

    seats = model.states
    hot, buckets = (seats.hot, seats.buckets) if seats else _dealt(model.words, model.n, p)
    if own and seats:
        answers = seats.answers
    else:
        asked = requests(chunks, hot, buckets)
        if not own:
            asked = asked.unionAll(requests(model.chunks, hot, buckets, ask=False))
        answers = materialise(responses(asked, hot), "py_answers")
    hot_table = spark.sparkContext.broadcast((hot, hot_kinds(answers, hot)))

    in_head = _in_head(model.words, p)
    by_state = [f"{x}{i}" for x in "pt" for i in range(p.samples + 1)] if seats else []
    head = model.words.where(in_head).select("h", "c", *by_state, *["lp"] * (not seats)).toArrow()
    h = np.append(head["h"].to_numpy().view(np.uint64), hashes([END]))
    by = np.argsort(h)
    ends = [*seats.end, *seats.end_tables] if seats else []
    lps = None if seats else np.append(head["lp"].to_numpy(), model.lp_end)[by]
    states = [np.append(head[x].to_numpy(), e)[by] for x, e in zip(by_state, ends)]
    shared = spark.sparkContext.broadcast((h[by], narrow(np.append(head["c"].to_numpy(), model.c_end)[by]), lps, [narrow(x) if name.startswith("t") else x for x, name in zip(states, by_state)]))
    del states, lps
    del head, h

    # The words of each chunk that the head does not hold.
    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value[0]
        for pdf in batches:
            for chunk, words in zip(pdf["chunk"], pdf["words"]):
                mine = hashes(words)
                at = np.flatnonzero(find(table, mine) < 0)
                yield pd.DataFrame({"chunk": chunk, "at": at, "h": mine[at].view(np.int64)})

    tail = chunks.select("chunk", "words").mapInPandas(others, "chunk long, at int, h long")
    of_word = ["c", *by_state] if seats else ["c", "lp"]  # lp follows from p1, p2, ...
    rest = model.words.where(~in_head).select("h", "c", *[F.when(F.col(x) != F.col("c"), F.col(x)).alias(x) if x.startswith("t") else x for x in of_word[1:]])
    tail = tail.join(rest, "h", "left").groupBy("chunk").agg(F.collect_list(F.struct("at", *of_word)).alias("tail"))
    tail = tail.select("chunk", *[F.col(f"tail.{c}").alias(f"t_{c}") for c in ("at", *of_word)])

    lp_unknown = model.lp_unknown
    unknown = seats.unknown if seats else None

    def sampled(pairs: Pairs, learned: np.ndarray, c: np.ndarray, of_state: list[np.ndarray], h: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Logs of the pairs' probabilities, averaged over samples: as events, and spelled."""
        prob = [np.where(np.isfinite(x), x, y) for x, y in zip(of_state[: p.samples + 1], unknown)]
        tables = [np.where(c > 0, np.nan_to_num(x), 0.0) for x in of_state[p.samples + 1 :]]
        events, spellings = np.empty(len(learned)), np.empty(len(learned))
        for a in range(0, len(learned), block):
            u, w, n = pairs.u[a : a + block], pairs.w[a : a + block], learned[a : a + block].astype(np.int64)
            event, spelled, new = 0.0, 0.0, c[w] == 0
            for i in range(1, p.samples + 1):
                t = seat_pairs(n, tables[i - 1][u], prob[i - 1][w], h[u], h[w], p.burn_in + i - 1, p)
                own, over = n - p.context_discount * t, p.context_strength + p.context_discount * tables[i][u]
                of = prob[i][w]
                event = event + own + over * np.where(new, unknown[i], of)
                spelled = spelled + own + over * of
            below = p.samples * (p.context_strength + c[u])
            events[a : a + block] = np.log(np.maximum(event / below, 1e-300))
            spellings[a : a + block] = np.log(np.maximum(spelled / below, 1e-300))
        return events, spellings

    def run(chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        """Scores of a chunk's texts from its words' and its pairs' counts."""
        if not len(chunk):
            return pd.DataFrame({c.split()[0]: [] for c in _RESULT.split(", ")})
        r = chunk.iloc[0]
        flat, mine = unpack(r["ids"], int(r["size"]), np.uint32), hashes(r["words"])
        table, counts, lps, states = shared.value
        at = find(table, mine)
        c = np.where(at >= 0, counts[at], 0).astype(np.int64)
        where = np.asarray(r["t_at"], dtype=np.int64) if r["t_at"] is not None and len(r["t_at"]) else []
        if len(where):
            c[where] = np.nan_to_num(np.asarray(r["t_c"], dtype=np.float64)).astype(np.int64)
        of_state = [np.where(at >= 0, x[at], np.nan) for x in states]
        for x, name in zip(of_state, by_state):
            if len(where):
                more = np.asarray(r[f"t_{name}"], dtype=np.float64)
                x[where] = np.where(np.isnan(more), c[where], more) if name.startswith("t") else more
        hot, kinds_of_hot = hot_table.value
        pairs = Pairs(flat, mine, hot, buckets, tokens=True)
        got = got[["bucket", "c", "pairs", "kinds", "firsts"]].sort_values("bucket")
        learned = np.concatenate([unpack(b, n, np.uint32) for b, n in zip(got["c"], got["pairs"])])
        if unknown is not None:
            value, spelled = sampled(pairs, learned, c, of_state, mine)
        else:
            lp = np.where(at >= 0, lps[at], -np.inf)
            if len(where):
                lp[where] = np.asarray(r["t_lp"], dtype=np.float64)
            lp = np.where(np.isfinite(lp), lp, lp_unknown)  # words of texts that the model has not listed
            event = np.where(c > 0, lp, lp_unknown)
            kinds = np.concatenate([unpack(b, n, np.uint32) for b, n in zip(got["kinds"], got["firsts"])]).astype(np.float64)
            first = pairs.u[pairs.start]
            at = find(hot, mine[first])
            kinds = np.repeat(np.where(at >= 0, kinds_of_hot[at], kinds), pairs.length)
            value = event[pairs.w] + context_term(learned.astype(np.float64), c[pairs.u], kinds, event[pairs.w], p)
            spelled = value + (lp - event)[pairs.w]
        tokens = pairs.tokens
        del pairs, learned, got, mine, of_state
        begin = np.concatenate([[0], np.cumsum(r["lens"])[:-1]]).astype(np.int64)
        add = lambda x: np.add.reduceat(x, begin)
        out = pd.DataFrame({"doc_id": pd.Series(r["doc_ids"], dtype="Int64").mask(np.asarray(r["no_id"], bool)), "n_tokens": r["lens"], "n_known": add((c > 0).astype(np.int64)[flat]), "b": add(np.log(c + 1.0)[flat]), "s": add(value[tokens]), "spelled": add(spelled[tokens])})
        del flat, tokens, value, spelled, c
        trim()
        return out

    chunks = chunks.select("chunk", "words", "ids", "size", "doc_ids", "no_id", "lens").join(tail, "chunk", "left")
    out = chunks.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk")).applyInPandas(run, _RESULT)
    release(spark, 0)
    ln10 = float(np.log(10.0))
    base = (F.col("b") - F.col("n_tokens") * float(np.log(model.n + model.v + 1))) / ln10
    out = out.select("doc_id", "n_tokens", "n_known", base.alias("base_score"), (F.col("spelled") / ln10).alias("score"), (F.col("s") / ln10).alias("event_score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
