"""Mixing sources to target token weights, with DataFrame functions only.

One pass sums the words of each source (a map-side aggregate, so a source that holds a third
of all rows costs no more).  The per-source table gives each source's target; the second
pass emits each document floor(rate) times, and once more if a hash of its id and text, as a
number in [0, 1), falls below the rate's fraction.  The hash depends on id, text and the seed
alone, so reruns and retried tasks agree, and rows that share an id, or have none, are drawn
apart as long as their texts differ.

Rates are targets over source sizes; with ``cap`` = 2 a rate of 2 leaves no fraction, so no
document is taken more than twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.operators.ordered import running_totals
from arborlake.plans.stage import materialise

#: A word, in Java's syntax.
WORD = r"[^\x20\x09-\x0D]+"
#: Digits of the id's hash that make the number in [0, 1).
_HEX, _SPAN = 13, float(16**13)


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code-point order, null last.  ``total``: share
    of all words that the mix should hold.  ``cap``: most times a source is repeated.
    ``broadcast_sources``: up to so many sources the per-source table is broadcast."""

    weights: tuple[int, ...] = (3, 1, 2)
    total: float = 1.5
    cap: float = 2.0
    seed: str = "mix-1"
    broadcast_sources: int = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, p: Mix = Mix()) -> DataFrame:
    """One row per source: source, source_size, weight, target.  Ranks and running sums come
    from ``running_totals``, so that not even the table of sources meets in one task.

    Without a cap a source gets lambda * weight.  A source whose share exceeds cap * size
    stops there and the excess goes to the others by weight, until none exceeds; so
    target = min(cap * size, lambda * weight) for the lambda at which the targets add up.
    Sorted by cap * size / weight, the capped sources come first, which gives lambda from
    running sums.  Sources without words have target 0."""
    sized = docs.select(F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    per = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix_sources")
    w = F.array(*[F.lit(x) for x in p.weights])
    ranked = running_totals(per, [F.col("source")], row_no="rank")
    per = ranked.select("source", "source_size", w[F.col("rank") % len(p.weights)].cast("long").alias("weight"))
    per = running_totals(per, [F.col("source_size") / F.col("weight"), F.col("source")], {"capped": F.col("source_size"), "closed": F.col("weight")})
    per = materialise(per, "mix_running")
    whole = per.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    lam = (F.lit(whole["n"] or 0) * F.lit(p.total) - F.col("capped") * F.lit(p.cap)) / (F.lit(whole["w"] or 1) - F.col("closed"))
    # The first open source's value is the level: those of later ones are only lower.
    level = per.agg(F.max(F.when(lam * F.col("weight") <= F.col("source_size") * F.lit(p.cap), lam))).first()[0]
    target = F.least(F.col("source_size") * F.lit(p.cap), F.lit(float("inf") if level is None else level) * F.col("weight"))
    return per.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix(docs: DataFrame, p: Mix = Mix(), keep: list[str] | None = None) -> DataFrame:
    """Each document once with doc_id, size, source_size, target, copies and taken, after the
    columns named in ``keep`` packed as struct ``row``.

    Null or empty text: size 0, and nothing is taken whatever its copies.  Null source: a source of its own,
    last in order.  Null id or text: hashed as the empty string.  Repeated rows: one result
    each, with equal copies.  Empty table: empty result."""
    targets = materialise(source_targets(docs, p), "mix_targets")
    few = targets.limit(p.broadcast_sources + 1).count() <= p.broadcast_sources
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    cols = [F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_key")]
    if keep is not None:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    rows = docs.select(*cols)
    if few:
        j = rows.join(F.broadcast(t), rows.source.eqNullSafe(t.t_source))
    else:
        j = rows.join(t, F.coalesce(F.concat(F.lit("s"), rows.source), F.lit("-")) == F.coalesce(F.concat(F.lit("s"), t.t_source), F.lit("-")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digest = F.md5(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_key")).cast("binary"))
    u = F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("long") / F.lit(_SPAN)
    copies = (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    out = j.select("doc_id", "size", "source_size", "target", copies.alias("copies"), *(["row"] if keep is not None else []))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, p: Mix = Mix()) -> DataFrame:
    """The mix itself: the documents' columns, each row repeated by its copies, and
    ``copy_no`` (from 1; renamed if the documents have such a column)."""
    name = "copy_no"
    while name in docs.columns:
        name = f"_{name}"
    m = mix(docs, p, keep=docs.columns).where("copies > 0")
    return m.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(name)).select("row.*", name)


#: The same rows in DuckDB.
ORACLE = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_key, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT source, source_size, ([3, 1, 2])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)]::BIGINT AS weight FROM s0),
s2 AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS full_size,
    coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
    sum(weight) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest
  FROM s1),
s3 AS (SELECT *, (full_size * 1.5::DOUBLE - capped * 2.0::DOUBLE) / rest AS lam FROM s2),
s4 AS (SELECT *, max(CASE WHEN lam * weight <= source_size * 2.0::DOUBLE THEN lam END) OVER () AS level FROM s3),
s5 AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce(level, 'inf'::DOUBLE) * weight) AS target FROM s4),
r AS (
  SELECT d.doc_id, d.size, s5.source_size, s5.target,
    CASE WHEN s5.source_size > 0 THEN s5.target / s5.source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.text_key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target,
  (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size AS taken
FROM r
"""
