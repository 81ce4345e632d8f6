"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Each whole text becomes its set of distinct 5-word shingles (64-bit hashes), a 128-bit
   key of that set, 180 minima and 36 bucket ids (36 bands of 5 minima: a pair at
   similarity 0.8 shares no bucket with probability (1 - 0.8^5)^36 = 6e-7).
2. Rows with equal sets collapse to one *node*, so exact copies cost nothing later.
3. Candidates are not all pairs of a bucket.  Round 1 compares each member with the
   bucket's smallest node; links found unite nodes.  Buckets whose members are then still
   in several classes are compared with the member that shares most buckets (the likely
   original).  Nodes that are left in open buckets get longer signatures (476 minima) and
   new, narrower buckets (68 bands of 7: a pair at 0.8 shares none with probability 1e-7), so
   that what shares a passage but little else is parted before pairs are compared.  There
   pairs are compared one by one, but only across classes, each pair in its first common
   bucket, in blocks of bounded size.
4. Each candidate is verified in batches of 30 minima (after BayesLSH): with a uniform prior
   the posterior of the similarity after m of n matches is Beta(m + 1, n - m + 1); the pair
   is dropped as soon as the chance that the similarity reaches the threshold falls below
   ``miss``.  Survivors are decided on the full shingle sets.
5. Connected components over the verified links; later rounds unite the classes of earlier
   ones by their new links alone.

A link between two nodes of one class is not looked for, since it can't change the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma, log, exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.textkit import MinHash, WordHash, set_key, shingle_set
from arborlake.operators.graph import connected_components
from arborlake.plans.stage import materialise


@dataclass(frozen=True)
class NearDup:
    """``percent``: least similarity in hundredths.  ``miss``: chance at which a candidate
    that may still be similar enough is given up.  ``batch``: minima compared at a time.
    ``more_bands``, ``more_rows``: bands and minima for the nodes that are left at the end.
    ``block``: rows of such a bucket that one comparison block holds.  ``broadcast_nodes``: up to
    so many candidate nodes (16-byte keys) are sent to all executors to filter the texts;
    beyond that, the texts are joined by shuffle."""

    percent: int = 80
    shingle: int = 5
    bands: int = 36
    rows: int = 5
    miss: float = 1e-6
    batch: int = 30
    more_bands: int = 68
    more_rows: int = 7
    block: int = 1024
    broadcast_nodes: int = 400_000


def least_matches(p: NearDup, k: int) -> np.ndarray:
    """least[n]: fewest matches after n of k minima with P(similarity >= threshold) >= miss."""
    t = p.percent / 100
    least = np.zeros(k + 1, dtype=np.int32)
    for n in range(p.batch, k + 1, p.batch):
        tail = 0.0  # P(Beta(m+1, n-m+1) > t) = P(Binomial(n+1, t) <= m)
        for m in range(n + 1):
            tail += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(t) + (n + 1 - m) * log(1 - t))
            if tail >= p.miss:
                least[n] = m
                break
    return least


def posterior_keeps(a: np.ndarray, b: np.ndarray, least: np.ndarray, batch: int) -> np.ndarray:
    """Rows of two signature matrices that no batch rules out."""
    alive = np.arange(len(a))
    seen = np.zeros(len(a), dtype=np.int32)
    for n in range(batch, a.shape[1] + 1, batch):
        seen = seen + (a[alive, n - batch : n] == b[alive, n - batch : n]).sum(axis=1, dtype=np.int32)
        ok = seen >= least[n]
        alive, seen = alive[ok], seen[ok]
        if not len(alive):
            break
    return alive


def _sketch(p: NearDup):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, mh = WordHash(), MinHash(p.bands, p.rows)
        for pdf in batches:
            n, keys, sigs, bands = [], [], [], []
            for text in pdf["text"]:
                s = shingle_set(text, cache, p.shingle)
                n.append(len(s))
                if len(s):
                    m = mh.minima(s)
                    keys.append(set_key(s))
                    sigs.append(m.astype(np.uint16).tobytes())
                    bands.append(mh.band_keys(m))
                else:
                    keys.append(None), sigs.append(None), bands.append(None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "n_shingles": n, "node": keys, "sig": sigs, "bands": bands})

    return run


def sketches(docs: DataFrame, p: NearDup) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_sketch(p), "doc_id long, text_hash long, n_shingles long, node binary, sig binary, bands array<long>")


def _longer(p: NearDup):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, mh = WordHash(), MinHash(p.more_bands, p.more_rows, seed=2)
        for pdf in batches:
            found = [mh.minima(shingle_set(t, cache, p.shingle)) for t in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "sig": [m.astype(np.uint16).tobytes() for m in found], "bands": [mh.band_keys(m) for m in found]})

    return run


def _bayes(p: NearDup):
    least = least_matches(p, p.bands * p.rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a = np.frombuffer(b"".join(pdf["sig_a"]), dtype=np.uint16).reshape(len(pdf), -1)
                b = np.frombuffer(b"".join(pdf["sig_b"]), dtype=np.uint16).reshape(len(pdf), -1)
                yield pdf.iloc[posterior_keeps(a, b, least, p.batch)][["a", "b"]]

    return run


def _exact(p: NearDup):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHash()
        last, sa = None, None
        for pdf in batches:
            keep = []
            for a, ta, tb in zip(pdf["a"], pdf["text_a"], pdf["text_b"]):
                if a != last:
                    last, sa = a, shingle_set(ta, cache, p.shingle)
                sb = shingle_set(tb, cache, p.shingle)
                both = np.concatenate([sa, sb])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= p.percent * (len(sa) + len(sb) - inter))
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _cross_pairs(p: NearDup):
    """Rows of one (bucket, block pair) at a time, in order: pairs of different classes
    whose first common bucket this is and that the posterior does not rule out."""
    k = p.more_bands * p.more_rows
    k -= k % p.batch
    least = least_matches(p, k)

    def pairs(g: pd.DataFrame) -> pd.DataFrame | None:
        if len(g) < 2:
            return None
        sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint16).reshape(len(g), -1)[:, :k]
        bands = np.stack(g["bands"].to_numpy())
        comp, node, n = g["cls"].to_numpy(), g["node"].to_numpy(), g["n_shingles"].to_numpy()
        code = pd.factorize(pd.Series(comp))[0]
        blk, bi, bj = g["blk"].to_numpy(), int(g["bi"].iloc[0]), int(g["bj"].iloc[0])
        here = int(np.flatnonzero(bands[0] == g["bucket"].iloc[0])[0])
        left = np.flatnonzero(blk == bi)
        right = left if bi == bj else np.flatnonzero(blk == bj)
        out_a, out_b = [], []
        for i in left:
            r = right[right > i] if bi == bj else right
            r = r[(code[r] != code[i]) & (100 * np.minimum(n[r], n[i]) >= p.percent * np.maximum(n[r], n[i]))]
            if here and len(r):
                r = r[~(bands[r, :here] == bands[i, :here]).any(axis=1)]
            if len(r):
                r = r[posterior_keeps(np.broadcast_to(sig[i], (len(r), sig.shape[1])), sig[r], least, p.batch)]
            for j in r:
                out_a.append(min(node[i], node[j])), out_b.append(max(node[i], node[j]))
        return pd.DataFrame({"a": out_a, "b": out_b}) if out_a else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key = pdf[["bucket", "bi", "bj"]]
            change = np.flatnonzero((key.values[1:] != key.values[:-1]).any(axis=1)) + 1
            edges = [0, *change.tolist(), len(pdf)]
            for s, t in zip(edges[:-2], edges[1:-1]):
                if (o := pairs(pdf.iloc[s:t])) is not None:
                    yield o
            held = pdf.iloc[edges[-2] :]
        if held is not None and (o := pairs(held)) is not None:
            yield o

    return run


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class _Linker:
    """Candidates in, verified links out."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, members: DataFrame, p: NearDup) -> None:
        self.p, self.nodes = p, nodes
        wanted = members.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash"), "node")
        wanted = materialise(wanted, "nd_wanted")
        small = wanted.limit(p.broadcast_nodes + 1).count() <= p.broadcast_nodes
        w = wanted.select("node", F.col("doc_id").alias("w_id"), "text_hash")
        rows = docs.select(F.col("doc_id").cast("long").alias("d_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
        j = rows.join(F.broadcast(w) if small else w, (rows.text_hash == w.text_hash) & rows.d_id.eqNullSafe(w.w_id))
        texts = materialise(j.select("node", "text"), "nd_texts")
        if texts.count() > wanted.count():  # repeated rows: the same id and text
            texts = materialise(texts.groupBy("node").agg(F.first("text").alias("text")), "nd_texts")
        self.texts = texts

    def longer(self, nodes: DataFrame) -> DataFrame:
        """(node, sig, bands) of the longer signatures."""
        return materialise(self.texts.join(nodes, "node", "left_semi").mapInPandas(_longer(self.p), "node binary, sig binary, bands array<long>"), "nd_longer")

    def verify(self, pairs: DataFrame, judged: bool = False) -> DataFrame:
        """pairs: distinct (a, b).  judged: the posterior test is already passed."""
        p = self.p
        if not judged:
            s = self.nodes.select("node", "n_shingles", "sig")
            x = s.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
            y = s.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))
            fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * p.percent
            pairs = pairs.join(x, "a").join(y, "b").where(fits).select("a", "b", "sig_a", "sig_b").mapInPandas(_bayes(p), "a binary, b binary")
        t = self.texts
        full = pairs.join(t.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(t.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        return full.select("a", "b", "text_a", "text_b").mapInPandas(_exact(p), "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, params: NearDup = NearDup()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are not read): doc_id,
    n_shingles, component_id (smallest non-null doc_id reachable), kept, text_hash.

    Null or wordless text: no shingles, linked with nothing, component_id = doc_id.
    Repeated rows and repeated ids: each row is placed by its own text; a text under
    several ids joins them.  Null doc_id: the row takes part by its text; component_id is null
    if no member has an id, and then the rows of one text of the class are kept.  Empty
    table: empty result."""
    p = params
    rows = materialise(sketches(docs, p), "nd_rows")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least_id"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("r"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("sig").alias("sig"),
        F.first("bands").alias("bands"),
    )
    nodes = materialise(nodes.select("node", "least_id", "r.doc_id", "r.text_hash", "n_shingles", "sig", "bands"), "nd_nodes")
    cc = _classes(docs, nodes, p)
    if cc is None:
        classes = nodes.select("node", F.col("least_id").alias("component_id"), F.lit(True).alias("first"))
    else:
        own = nodes.select("node", "least_id").join(cc, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component"))
        own = materialise(own, "nd_own")
        least = materialise(own.groupBy("component").agg(F.min("least_id").alias("component_id")), "nd_least")
        classes = own.join(least, "component").select("node", "component_id", (F.col("node") == F.col("component")).alias("first"))
    out = rows.select("doc_id", "n_shingles", "node", "text_hash").join(classes, "node", "left")
    comp = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.when(comp.isNotNull(), F.coalesce(F.col("doc_id") == comp, F.lit(False))).otherwise(F.coalesce("first", F.lit(True)))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), kept.alias("kept"), "text_hash")


def deduplicated(docs: DataFrame, params: NearDup = NearDup()) -> DataFrame:
    """The documents' columns with one row of each class left."""
    found = materialise(near_duplicates(docs, params).select("doc_id", "text_hash", "kept"), "nd_found")
    gone = found.where("not kept").select(F.col("doc_id").alias("_g_id"), F.col("text_hash").alias("_g_hash")).distinct()
    small = gone.limit(params.broadcast_nodes + 1).count() <= params.broadcast_nodes
    match = docs["doc_id"].cast("long").eqNullSafe(F.col("_g_id")) & (F.xxhash64(docs["text"]) == F.col("_g_hash"))
    out = docs.join(F.broadcast(gone) if small else gone, match, "left_anti")
    kept = found.where("kept")
    if kept.count() > kept.select("doc_id", "text_hash").distinct().count():  # repeated rows
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def _classes(docs: DataFrame, nodes: DataFrame, p: NearDup) -> DataFrame | None:
    """(node, component) of the nodes with a link; None if no bucket is shared."""
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("rep")).where("size > 1")
    # Aggregates by bucket are written before they are joined by bucket: a join that deals both
    # sides itself can split a bucket that holds many rows.
    shared = materialise(shared, "nd_shared")
    members = materialise(entries.join(shared, "bucket").select("bucket", "node", "rep"), "nd_members")
    if members.isEmpty():
        return None
    linker = _Linker(docs, nodes, members, p)

    first = members.where("node <> rep").select(*_ordered(F.col("node"), F.col("rep"))).distinct()
    classes = _united(None, materialise(linker.verify(first), "nd_links1"))
    open_ = _still_open(members.where("node <> rep").select("bucket", "node"), classes)
    if open_.isEmpty():
        return classes

    # Round 2: the member that shares most open buckets with others is the likely original.
    size = materialise(open_.groupBy("bucket").agg(F.count("*").alias("size")), "nd_size")
    weight = open_.join(size, "bucket").groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = open_.join(weight, "node")
    hub = weighed.groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("rep"), F.max_by("cls", F.struct("weight", "node")).alias("rep_cls"))
    second = materialise(open_.join(materialise(hub, "nd_hub"), "bucket"), "nd_members2")
    pairs = second.where("node <> rep and cls <> rep_cls").select(*_ordered(F.col("node"), F.col("rep"))).distinct()
    classes = _united(classes, materialise(linker.verify(pairs), "nd_links2"))
    open_ = _still_open(second.where("node <> rep").select("bucket", "node"), classes)
    if open_.isEmpty():
        return classes

    # The rest, whole: narrower buckets, and in them pairs across classes, by blocks.
    left = materialise(open_.groupBy("node").agg(F.first("cls").alias("cls")), "nd_left")
    longer = linker.longer(left.select("node"))
    narrow = materialise(longer.select("node", F.explode("bands").alias("bucket")).join(left, "node"), "nd_narrow")
    size = narrow.groupBy("bucket").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.ceil(F.count("*") / F.lit(p.block)).cast("int").alias("nb"))
    size = materialise(size.where("lo <> hi").select("bucket", "nb"), "nd_blocks")
    rest = narrow.join(size, "bucket").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rest = rest.select("bucket", "node", "cls", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"))
    rest = rest.join(longer, "node").join(nodes.select("node", "n_shingles"), "node")
    dealt = rest.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "node")
    pairs = dealt.mapInPandas(_cross_pairs(p), "a binary, b binary").distinct()
    return _united(classes, materialise(linker.verify(materialise(pairs, "nd_pairs3"), judged=True), "nd_links3"))


def _united(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) of all linked nodes, from earlier classes and new links between
    nodes: only classes that new links join are looked at again.  A class is named by its
    least node."""
    if classes is None:
        return materialise(connected_components(links, "a", "b"), "nd_classes")
    own = lambda c, name: classes.select(F.col("node").alias(c), F.col("component").alias(name))
    e = links.join(own("a", "ca"), "a", "left").join(own("b", "cb"), "b", "left")
    e = materialise(e.select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb").distinct(), "nd_joined")
    if e.isEmpty():
        return classes
    cc = materialise(connected_components(e, "ca", "cb"), "nd_joint").select(F.col("node").alias("old"), F.col("component").alias("new"))
    known = classes.join(cc, classes["component"] == cc["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = cc.join(classes.select("node"), cc["old"] == classes["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return materialise(known.unionAll(fresh), "nd_classes")


def _still_open(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members (bucket, node, cls) of buckets that hold nodes of several classes."""
    own = members.join(classes, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("cls"))
    own = materialise(own, "nd_own_classes")
    mixed = own.groupBy("bucket").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("bucket")
    mixed = materialise(mixed, "nd_mixed")
    return materialise(own.join(mixed, "bucket", "left_semi"), "nd_open")
