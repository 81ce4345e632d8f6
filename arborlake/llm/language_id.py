"""Language identification by nearest centroid.

A whole text becomes a TF-IDF vector of hashed character 1- to 3-grams (letters folded,
everything else one blank), scaled to length 1.  Each language has several centroids from
spherical k-means; a text goes to the language of the centroid with the largest cosine.

A text too far from its language's centroids is rejected.  How far is too far depends on the
language and on the text's length, as short texts share few n-grams with anything: the floor
is ``slack`` of the least cosine of the language's sample among texts of like or greater
length (by powers of two of their letters).  Lengths of which a language has fewer than
``enough`` texts take the least over all languages, with the slack twice if these have not half as
many, and those that no text of the sample has the floor of the next shorter length, or none.

Document frequencies come from all training rows.  The clusters are fitted on a bounded
sample: about ``sample`` rows for each language, those with the smallest id hashes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"


@dataclass(frozen=True)
class LangId:
    """``dims``: hashed n-gram features (a power of 2).  ``clusters``: centroids a language.
    ``sample``: rows a language that fit them.  ``max_languages``: the model is broadcast, so
    of more labels those with most rows are learned (ties by name), and texts of the others go
    to the nearest of these or are rejected.  ``slack``, ``enough``: see above.
    ``sharpness``: scale of the cosines in the score."""

    dims: int = 8192
    clusters: int = 3
    sample: int = 1200
    rounds: int = 8
    max_languages: int = 400
    slack: float = 0.75
    enough: int = 20
    sharpness: float = 30.0


_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point -> lower-case letter, 0 if it is no letter."""
    global _fold
    if _fold is None:
        t = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                t[c] = ord(ch.lower()[0])
        _fold = t
    return _fold


LENGTHS = 40  # classes of length: whole logs to base 2 of the number of letters


def gram_counts(text: str, dims: int) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams; None if the text has no letter."""
    c = fold_table()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    if not c.any():
        return None
    c = np.concatenate([np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)])
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    shift = np.uint32(32 - dims.bit_length() + 1)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] + c[1:]) * np.uint32(0x85EBCA6B)
    three = (two[:-1] + c[2:]) * np.uint32(0xC2B2AE35)
    two ^= two >> np.uint32(15)
    two *= np.uint32(0x2C1B3C6D)
    three ^= three >> np.uint32(15)
    three *= np.uint32(0x297A2D39)
    return np.bincount(np.concatenate([one[c != 0] >> shift, two >> shift, three >> shift]), minlength=dims)


def length_class(text: str) -> int:
    """-1 without a letter."""
    n = int(np.count_nonzero(fold_table()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]))
    return min(n.bit_length(), LENGTHS) - 1


def vectors(texts, dims: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF rows and which of them have a letter."""
    x = np.zeros((len(texts), dims), dtype=np.float32)
    ok = np.zeros(len(texts), dtype=bool)
    for i, text in enumerate(texts):
        n = gram_counts(text, dims) if text else None
        if n is not None:
            at = np.flatnonzero(n)
            v = (1 + np.log(n[at])) * idf[at]
            x[i, at] = v / max(float(np.sqrt((v * v).sum())), 1e-12)
            ok[i] = True
    return x, ok


def cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; at most k unit centroids, none empty."""
    mean = x.mean(axis=0)
    centre = [mean / max(float(np.linalg.norm(mean)), 1e-12)]
    near = x @ centre[0]
    for _ in range(min(k, len(x)) - 1):
        # a seed from the outer tenth, not the very farthest row, which may be junk
        at = int(np.argsort(near, kind="stable")[len(x) // 10])
        centre.append(x[at])
        near = np.maximum(near, x @ x[at])
    c = np.stack(centre)
    for _ in range(rounds):
        who = np.argmax(x @ c.T, axis=1)
        means = [x[who == j].mean(axis=0) for j in range(len(c)) if (who == j).any()]
        c = np.stack([m / max(float(np.linalg.norm(m)), 1e-12) for m in means])
    return c


@dataclass
class Model:
    params: LangId
    idf: np.ndarray
    langs: list[str]
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.float32))
    floor: np.ndarray = field(default_factory=lambda: np.zeros((0, LENGTHS)))  # by language and length

    def predict(self, texts: list[str | None], step: int = 256) -> pd.DataFrame:
        out = []
        for i in range(0, len(texts), step):
            x, ok = vectors(texts[i : i + step], self.params.dims, self.idf)
            n = len(x)
            if not self.langs:
                out.append(pd.DataFrame({"lang_pred": [UNDETERMINED] * n, "score": 0.0, "similarity": 0.0, "rejected": True}))
                continue
            sim = x @ self.centroids.T
            best = np.full((n, len(self.langs)), -1.0)
            for j in range(len(self.langs)):
                best[:, j] = sim[:, self.owner == j].max(axis=1)
            top = best.argmax(axis=1)
            e = np.exp((best - best.max(axis=1, keepdims=True)) * self.params.sharpness)
            score, s = e.max(axis=1) / e.sum(axis=1), np.clip(best.max(axis=1), 0, 1)
            size = np.array([length_class(t) if t else 0 for t in texts[i : i + step]])
            pred = np.array(self.langs, dtype=object)[top]
            pred[~ok] = UNDETERMINED
            out.append(pd.DataFrame({"lang_pred": pred, "score": np.where(ok, score, 0.0), "similarity": np.where(ok, s, 0.0), "rejected": ~ok | (s < self.floor[top, size])}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": [], "score": [], "similarity": [], "rejected": []})


def fit(train: DataFrame, p: LangId = LangId()) -> Model:
    """Learn from (doc_id, text, lang) rows; rows without lang or letters are left out."""
    rows = train.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(p.max_languages + 1).collect()
    sizes = {r["lang"]: r["n"] for r in found[: p.max_languages]}
    if len(found) > p.max_languages:
        rows = rows.where(F.col("lang").isin(*sizes))
    langs = sorted(sizes)
    dims = p.dims

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(dims, dtype=np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                c = gram_counts(text, dims)
                if c is not None:
                    df += c > 0
                    n += 1
        if n:
            at = np.flatnonzero(df)
            yield pd.DataFrame({"i": np.append(at, -1), "n": np.append(df[at], n)})

    df = np.zeros(dims + 1, dtype=np.int64)
    if langs:
        for r in rows.select("text").mapInPandas(frequencies, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # dims + 1 rows at most
            df[r["i"]] = r["n"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    if not langs or not df[-1]:
        return Model(p, idf, [])

    # A hash of the id below sample / rows of the language: about ``sample`` rows of each.
    share = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(min(1.0, p.sample / n)))])
    unit = F.conv(F.substring(F.md5(F.concat(F.lit("lang:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    sample = rows.where(unit < share[F.col("lang")]).select("lang", "text").distinct()  # repeated rows can't swell it

    def centroids(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(pdf["text"])
        x, ok = vectors(texts, dims, idf)
        x, size = x[ok], [length_class(t) for t, o in zip(texts, ok) if o]
        if not len(x):
            return pd.DataFrame({"lang": [], "c": [], "n": [], "size": [], "near": []})
        c = cluster(x, p.clusters, p.rounds)
        s = x @ c.T
        n = np.bincount(s.argmax(axis=1), minlength=len(c))
        out = pd.DataFrame({"lang": key[0], "c": [v.astype(np.float32).tobytes() for v in c], "n": n, "size": None, "near": None})
        out.at[0, "size"], out.at[0, "near"] = size, s.max(axis=1).tolist()
        return out

    got = sample.groupBy("lang").applyInPandas(centroids, "lang string, c binary, n long, size array<int>, near array<double>").collect()
    texts = {r["lang"]: (np.array(r["size"]), np.array(r["near"])) for r in got if r["size"] is not None}  # ``sample`` a language
    got = sorted(got, key=lambda r: (r["lang"], -r["n"], r["c"]))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return Model(p, idf, [])
    c = np.stack([np.frombuffer(r["c"], dtype=np.float32) for r in got])
    n = np.array([r["n"] for r in got], dtype=np.float64)
    owner = np.array([langs.index(r["lang"]) for r in got])
    # A small cluster that lies nearer to another language's centre holds mislabelled rows.
    centre = np.stack([(c[owner == j] * n[owner == j, None]).sum(axis=0) for j in range(len(langs))])
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    sim = c @ centre.T
    total = np.array([n[owner == j].sum() for j in range(len(langs))])
    good = (sim.argmax(axis=1) == owner) | (n >= 0.3 * total[owner])
    return Model(p, idf, langs, owner[good], c[good], floors([texts[g] for g in langs], p))


def floors(samples: list[tuple[np.ndarray, np.ndarray]], p: LangId) -> np.ndarray:
    """Least cosines allowed by language and length class, from (length class, cosine) of each
    language's sample."""
    least = np.full((len(samples), LENGTHS), np.inf)
    count = np.zeros((len(samples), LENGTHS), dtype=int)
    for j, (size, near) in enumerate(samples):
        np.minimum.at(least[j], size, near)
        np.add.at(count[j], size, 1)
    least = np.where(count < p.enough, least.min(axis=0), least)
    least = np.minimum.accumulate(least[:, ::-1], axis=1)[:, ::-1]  # longer texts are no farther
    some = count.sum(axis=0) > 0
    first, out = int(np.argmax(some)), np.zeros_like(least)
    for k in range(LENGTHS):
        out[:, k] = least[:, k] if some[k] else (out[:, k - 1] if k > first else 0.0)
    few = 2 * count.sum(axis=0) < p.enough  # over all languages: a least of few says little
    return np.where(np.isfinite(out), out, 0.0) * np.where(few, p.slack**2, p.slack)


def predictor(spark, model: Model):
    """A function Column -> struct<lang_pred, score, similarity, rejected> over whole texts.
    Null text or no letter: ``und``, score 0, rejected."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, similarity double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield m.predict(texts.tolist())

    return predict


def held_out(modulus: int, remainder: int) -> Column:
    """crc32 of the id as text has this remainder; null ids are hashed as the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, similarity, rejected for every row of (doc_id, text),
    repeated rows included.  Nothing but the text is an input."""
    r = predictor(docs.sparkSession, model)(F.col("text").cast("string"))
    return docs.select("doc_id", r.alias("r")).select("doc_id", "r.*")
