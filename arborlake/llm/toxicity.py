"""Toxicity by class-conditional Kneser-Ney models of words.

Two models, one of toxic and one of ordinary texts, give each word a probability.  With n
the class's Kneser-Ney count (after how many different words it stands there, so copies of a
text add nothing), N their sum, V distinct words and discount D,

    p_class(w) = (max(n(w) - D, 0) + D V p_shared(w)) / N

The shared back-off counts are of the same kind: a word counts once for each class that knows
it, however often.  So what one class has seen a hundred times and the other never tells much,
and what a class has seen once tells little.  The shared counts back off to the word's
spelling, letter by letter: the class's counts of (up to ``order`` letters before, letter) over
its distinct words, over shared counts of the same (again once for each class), over those of
shorter contexts, down to equal letters.  An inflected form that no label knows thus takes
over what is known of its stem.

A text's figures are the words' log-likelihood ratios, normalised in different ways by its
length: their mean, the log of the mean ratio, the mean of the two largest, and the evidence
beyond ``strong`` per root of the length; with the log of that evidence and of the length they
go into a logistic link, fitted on texts that the counts have not seen.

The models are fitted on a bounded sample of labelled rows: about ``sample`` of them, those
with the smallest id hashes.  Scores cover every row and whole texts.
"""

from __future__ import annotations

import collections
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.textkit import mix64
from arborlake.llm.word_chunks import find
from arborlake.plans.stage import materialise, release

STATS = ["mean", "log_mean", "top2", "per_root", "log_strong", "log_length"]
#: A run of letters; everything else parts words.
_WORD = re.compile(r"[^\W\d_]+")
_START, _STOP = 1, 2  # control characters, so no letters: before and after a word
_FACTOR = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) | 1 for k in range(32)], dtype=np.uint64)


@dataclass(frozen=True)
class Tox:
    """``sample``: labelled rows that fit the models; every fourth of them fits the link.
    ``order``: letters of context (31 at most).  ``strong``: ratio (natural log) beyond which a word counts
    as evidence; ``most``: largest ratio of one word.  ``threshold``: score from which a text
    is predicted toxic.  ``remember``: letters of words whose ratios a worker keeps."""

    sample: int = 24_000
    order: int = 6
    discount: float = 0.85
    strong: float = 2.0
    most: float = 8.0
    threshold: float = 0.3
    remember: int = 2_000_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _spell(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters and ends of the words: their codes, how many letters (with the start) stand
    before each in its word, and where each word begins."""
    codes = np.frombuffer("".join(f"{chr(_START)}{w}{chr(_STOP)}" for w in words).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    begin = np.flatnonzero(codes == _START)
    place = np.arange(len(codes)) - np.repeat(begin, np.diff(np.append(begin, len(codes))))
    return codes, np.minimum(place, order), begin


def _context_sums(codes: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For context lengths 0 to ``order``: one number for the codes before each place."""
    total = np.zeros(len(codes), dtype=np.uint64)
    yield total
    for k in range(1, order + 1):
        total = total.copy()
        total[k:] += mix64(codes[:-k]) * _FACTOR[k]
        yield total


def _gram(context: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return mix64(context + mix64(codes + np.uint64(7)) * _FACTOR[0])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def count_letters(words: list[str], toxic: np.ndarray, ordinary: np.ndarray, k: int, step: int = 50_000) -> dict[str, np.ndarray]:
    """Letters after contexts of k letters, over distinct words: key, context, key after one
    letter less of context, and the number of words of each class; ``step`` words at a time."""
    out = None
    for i in range(0, max(len(words), 1), step):
        part = _count_some(words[i : i + step], toxic[i : i + step], ordinary[i : i + step], k)
        if out is not None:
            both = {c: np.concatenate([out[c], part[c]]) for c in part}
            order = np.argsort(both["key"], kind="stable")
            key = both["key"][order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            part = {c: np.add.reduceat(v[order], first) if c in ("toxic", "ordinary") else v[order][first] for c, v in both.items()} if len(key) else both
        out = part
    return out


def _count_some(words: list[str], toxic: np.ndarray, ordinary: np.ndarray, k: int) -> dict[str, np.ndarray]:
    codes, before, begin = _spell(words, k)
    sums = collections.deque(_context_sums(codes, k), maxlen=2)
    ok = (before >= k) & (codes != _START)
    of = np.repeat(np.arange(len(words)), np.diff(np.append(begin, len(codes))))[ok]
    key, context, shorter = _gram(sums[-1][ok], codes[ok]), mix64(sums[-1][ok] + np.uint64(k)), _gram(sums[0][ok], codes[ok])
    (a, n), (b, m) = _runs(key[toxic[of]]), _runs(key[ordinary[of]])
    every, first = np.unique(key, return_index=True)
    out = {"key": every, "context": context[first], "shorter": shorter[first], "toxic": np.zeros(len(every), np.int32), "ordinary": np.zeros(len(every), np.int32)}
    out["toxic"][np.searchsorted(every, a)] = n
    out["ordinary"][np.searchsorted(every, b)] = m
    return out


@dataclass
class Letters:
    """For each context length: keys of letters in context, sorted, with the probabilities
    toxic, ordinary and shared; contexts, sorted, with what each of the three leaves over."""

    alphabet: int = 1
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def learn(self, counts: dict[str, np.ndarray], d: float) -> None:
        """Add the next context length, from ``count_letters``."""
        key = np.asarray(counts["key"])
        if not self.grams:
            self.alphabet = len(key) + 1  # one more for letters never seen
        c = np.stack([counts["toxic"], counts["ordinary"]], axis=1).astype(np.float32)
        c = np.c_[c, (c > 0).sum(axis=1, dtype=np.float32)]  # shared: once for each class
        context, at = np.unique(counts["context"], return_inverse=True)
        total = np.stack([np.bincount(at, c[:, j], len(context)) for j in range(3)], axis=1)
        kept = np.stack([np.bincount(at, np.minimum(c[:, j], d), len(context)) for j in range(3)], axis=1)
        left = np.where(total > 0, kept / np.maximum(total, 1e-9), 1.0)
        if self.grams:
            keys, probs = self.grams[-1]
            lower = probs[find(keys, np.asarray(counts["shorter"])), 2].astype(np.float64)
        else:
            lower = np.full(len(key), 1.0 / self.alphabet)
        own = np.where(total[at] > 0, np.maximum(c - d, 0) / np.maximum(total[at], 1e-9), 0.0)
        shared = own[:, 2] + left[at, 2] * lower
        probs = np.c_[own[:, 0] + left[at, 0] * shared, own[:, 1] + left[at, 1] * shared, shared]
        order = np.argsort(key)
        self.grams.append((key[order], probs[order].astype(np.float32)))
        self.contexts.append((context, left.astype(np.float32)))

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Natural logs of the words' spellings, their ends included: toxic, ordinary.  From
        the longest context down until the letter is known there."""
        out = np.zeros((len(words), 2))
        top = len(self.grams) - 1
        if top < 0 or not words:
            return out
        codes, before, begin = _spell(words, top)
        sums = list(_context_sums(codes, top))
        todo = np.flatnonzero(codes != _START)
        p = np.ones((len(codes), 2))
        rest = np.ones(len(codes))  # what the shared contexts passed so far leave over
        seen = np.zeros(len(codes), dtype=bool)
        for k in range(top, -1, -1):
            here = todo[before[todo] >= k]
            (keys, probs), (contexts, left) = self.grams[k], self.contexts[k]
            at = find(keys, _gram(sums[k][here], codes[here]))
            hit, known = here[at >= 0], probs[at[at >= 0]]
            p[hit] = np.where(seen[hit, None], p[hit] * (rest[hit] * known[:, 2])[:, None], known[:, :2])
            miss = here[at < 0]
            at = find(contexts, mix64(sums[k][miss] + np.uint64(k)))
            miss, over = miss[at >= 0], left[at[at >= 0]]
            new = ~seen[miss]
            p[miss[new]] = over[new, :2]
            seen[miss] = True
            rest[miss] *= over[:, 2]
            done = np.zeros(len(codes), dtype=bool)
            done[hit] = True
            todo = todo[~done[todo]]
        p[todo] *= (rest[todo] / self.alphabet)[:, None]
        p[codes == _START] = 1.0
        return np.add.reduceat(np.log(np.maximum(p, 1e-300)), begin, axis=0)


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in words), dtype=np.uint64, count=len(words))


@dataclass
class Model:
    """``known``: hashes of the learned words, sorted, with ``counts`` (toxic, ordinary).
    ``span``: least and largest figures that the link was fitted on; beyond them it is level."""

    params: Tox
    prior: float
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    letters: Letters = field(default_factory=Letters)
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    span: np.ndarray | None = None
    memory: dict[str, float] = field(default_factory=dict)
    held: int = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}, "held": 0}

    def probs(self, words: list[str]) -> np.ndarray:
        """p(word): toxic, ordinary."""
        d, n = self.params.discount, self.counts
        at = find(self.known, _hashes(words))
        c = np.where(at[:, None] >= 0, n[at] if len(n) else 0.0, 0.0)
        classes, kinds = (c > 0).sum(axis=1), (n > 0).sum(axis=0)
        spelled = np.exp(self.letters.log_probs(words))
        shared = (np.maximum(classes - d, 0)[:, None] + d * len(n) * spelled) / kinds.sum()
        return (np.maximum(c - d, 0) + d * kinds * shared) / n.sum(axis=0)

    def ratios(self, words: list[str]) -> np.ndarray:
        p = np.log(np.maximum(self.probs(words), 1e-300))
        return np.clip(p[:, 0] - p[:, 1], -self.params.most, self.params.most)

    def stats(self, texts, step: int = 25_000) -> np.ndarray:
        """STATS of each text; the ratios of new words are found for many texts at once."""
        p, out, i = self.params, np.full((len(texts), len(STATS)), np.nan), 0
        while i < len(texts):
            group, new, total = [], {}, 0
            while i + len(group) < len(texts) and len(new) < step and total < 4 * step:
                group.append(words_of(texts[i + len(group)]))
                total += len(group[-1])
                new.update((w, None) for w in group[-1] if w not in self.memory)
            found = list(new)
            size = 0
            for a in range(0, len(found), step):  # a text may hold any number of words
                part = found[a : a + step]
                self.memory.update(zip(part, self.ratios(part).tolist()))
            size = sum(map(len, found))
            get = self.memory.__getitem__
            for words in group:
                if words:
                    s, n = np.fromiter(map(get, words), dtype=np.float64, count=len(words)), len(words)
                    two = np.partition(s, -2)[-2:].mean() if n > 1 else s[0] / 2
                    strong = np.maximum(s - p.strong, 0).sum()
                    out[i] = s.mean(), np.log(np.exp(s).mean()), two, strong / np.sqrt(n), np.log1p(strong), np.log(n)
                i += 1
            self.held += size
            if self.held > p.remember:
                self.memory.clear()
                self.held = 0
        return out

    def score(self, texts) -> np.ndarray:
        """Scores of texts; without a word, or with nothing learned, the share of toxic labels."""
        if self.weights is None:
            return np.full(len(texts), self.prior)
        s = np.clip(self.stats(texts), *self.span)
        z = np.c_[np.ones(len(s)), (s - self.centre) / self.scale] @ self.weights
        return np.where(np.isnan(z), self.prior, 1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit_link(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps."""
    centre, scale = s.mean(axis=0), s.std(axis=0)
    scale = np.where(scale > 1e-3, scale, 1.0)  # a figure that never changes gets no weight
    a = np.c_[np.ones(len(s)), (s - centre) / scale]
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6, *[0.5] * s.shape[1]])
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (q - y) + ridge @ w
        hess = (a * (q * (1 - q))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, g)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, w


def fit(docs: DataFrame, labels: DataFrame, p: Tox = Tox()) -> Model:
    """docs (doc_id, text) and labels (doc_id, toxic); rows without a label of 0 or 1, or
    without text, are left out, of repeated labels the largest holds.  Without labels the
    score is 0, with labels of one class it is their share."""
    lab = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where("l_id is not null and toxic in (0, 1)")
    lab = lab.groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = sum(total.values())
    prior = total.get(1, 0) / n if n else 0.0
    if len(total) < 2:
        return Model(p, prior)
    unit = F.conv(F.substring(F.md5(F.concat(F.lit("tox:"), F.col("l_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    lab = lab.where(unit < int(min(1.0, p.sample / n) * (1 << 32))).withColumn("aside", unit % 4 == 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(lab), rows.doc_id == lab.l_id).select("text", "toxic", "aside")  # about ``sample`` labels

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: tuple[set, set] = set(), set()
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                w = words_of(text)
                seen[toxic].update(zip(["", *w], w))
            for toxic in (0, 1):
                if seen[toxic]:
                    u, w = zip(*seen[toxic])
                    yield pd.DataFrame({"u": u, "w": w, "toxic": toxic})

    # A word's count in a class: after how many different words it stands there.
    follows = rows.where("not aside and text is not null").select("text", "toxic").mapInPandas(pairs, "u string, w string, toxic int")
    follows = follows.select("w", F.xxhash64("u").alias("u"), "toxic").distinct()
    words = materialise(follows.groupBy("w").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("ordinary")), "tox_words")

    # Letters by length of context: one task at a time over the sample's words.
    def letters(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = count_letters(pdf["w"].tolist(), pdf["toxic"].to_numpy() > 0, pdf["ordinary"].to_numpy() > 0, int(key[0]))
        return pd.DataFrame([(key[0], *[c[x].astype(t).tobytes() for x, t in _LETTERS.items()])], columns=["k", *_LETTERS])

    model = Model(p, prior)
    for k in range(p.order + 1):
        got = words.groupBy(F.lit(k).alias("k")).applyInPandas(letters, "k int, " + ", ".join(f"{x} binary" for x in _LETTERS))
        for r in got.toLocalIterator():  # one row, bounded by the sample
            model.letters.learn({x: np.frombuffer(r[x], dtype=t) for x, t in _LETTERS.items()}, p.discount)
            del r
    hashed = words.mapInPandas(_hash_words, "h long, toxic long, ordinary long").toArrow()
    if not hashed.num_rows or not all(hashed[c].to_numpy().any() for c in ("toxic", "ordinary")):
        return Model(p, prior)
    h = hashed["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    model.known, model.counts = h[order], np.stack([hashed[c].to_numpy()[order] for c in ("toxic", "ordinary")], axis=1).astype(np.float32)

    del hashed, h, order
    release(rows.sparkSession, 0)  # what counting letters took
    shared = rows.sparkSession.sparkContext.broadcast(model)
    # Wordless texts go here: a filter above the figures would have Spark compute them twice, by
    # two workers for each task, each with the model.
    aside = rows.where("aside").select("toxic", stats_of(shared)(F.col("text")).alias("s")).select("toxic", "s.*").toPandas()  # about a fourth of ``sample``
    aside = aside[aside["mean"].notna()]
    shared.destroy()
    y = aside["toxic"].to_numpy(np.float64)
    if 0 < y.sum() < len(y):
        model.centre, model.scale, model.weights = fit_link(aside[STATS].to_numpy(), y)
        model.span = np.stack([aside[STATS].min(), aside[STATS].max()])
    return model


_LETTERS = {"key": np.uint64, "context": np.uint64, "shorter": np.uint64, "toxic": np.int32, "ordinary": np.int32}


def _hash_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"h": _hashes(pdf["w"].tolist()).view(np.int64), "toxic": pdf["toxic"], "ordinary": pdf["ordinary"]})


def stats_of(shared):
    @F.pandas_udf(", ".join(f"{s} double" for s in STATS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(shared.value.stats(texts.tolist()), columns=STATS)

    return run


def scorer(spark, model: Model):
    """A function Column -> score in [0, 1] of whole texts; null, empty and wordless texts
    get the share of toxic labels."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(texts.tolist()))

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of (doc_id, text), repeated rows included."""
    s = scorer(docs.sparkSession, model)(F.col("text").cast("string"))
    out = docs.select("doc_id", s.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= model.params.threshold).cast("int"))
