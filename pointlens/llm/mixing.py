"""Mixing sources to target weights by Poisson replication.

A source s with size n_s (code points of its texts, plus one for each document) and target share w_s gets the mean
repetition rate  rate_s = w_s * sum(n) / n_s.  A document's number of copies inverts the Poisson distribution of that mean
at a uniform number hashed from seed and document, so it is the same on every run and in every partition. Copies are
exploded and dealt out by a hash of seed, document and copy, which is also the order inside each partition: a global shuffle.

Rates above `part_rate` are split into equal parts with a hash each, so that no probability underflows.

Defined cases: null is a source of its own; sources that are missing from given weights get weight 0 and no copies; weights that are
empty, all 0 or of other sources only give an empty result; a null weight is 0; a negative, infinite or NaN weight raises an error; a
null text has size 1; a null id is replaced in the hash by the text's MD5; repeated rows get the same number of
copies each; an empty table gives an empty result. Columns of the input named like the two added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlens.llm.common import checkpoint, quoted, small

PART_RATE = 64.0
COPY, KEY = "copy", "shuffle_key"


def source_rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """_source, rate. weights: columns source, weight; without it a source's share is proportional to its size to the power alpha."""
    sizes = docs.groupBy(F.col(source_col).alias("_source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("long") + 1).alias("_size"))
    sizes = checkpoint(sizes)
    if weights is None:
        weighed = sizes.withColumn("_weight", F.pow(F.col("_size").cast("double"), F.lit(alpha)))
    else:
        value = F.col("weight").cast("double")
        if not weights.where((value < 0) | F.isnan(value) | (value == float("inf"))).isEmpty():
            raise ValueError("weights must be finite and not negative")
        given = weights.groupBy(F.col("source").alias("_given")).agg(F.sum(value).alias("_weight"))
        weighed = sizes.join(given, F.col("_source").eqNullSafe(F.col("_given")), "left").select("_source", "_size", F.coalesce("_weight", F.lit(0.0)).alias("_weight"))
    totals = weighed.agg(F.sum("_weight").alias("_all_weight"), F.sum("_size").alias("_all_size"))
    rate = F.when(F.col("_all_weight") > 0, F.col("_weight") / F.col("_all_weight") * F.col("_all_size") / F.col("_size")).otherwise(F.lit(0.0))
    return weighed.join(F.broadcast(totals)).select("_source", rate.alias("_rate"))  # totals is one row


def _with_distribution(rates: DataFrame) -> DataFrame:
    """Adds _parts and _cdf, the distribution function of one part at 0, 1, ... as far as a double can tell it from 1."""
    parted = rates.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART_RATE)).cast("int")).withColumn("_part_rate", F.col("_rate") / F.col("_parts"))
    return parted.withColumn(
        "_cdf",
        F.expr(
            """transform(
                 aggregate(
                   sequence(1, cast(ceil(_part_rate + 12 * sqrt(_part_rate) + 30) as int)),
                   array(struct(exp(-_part_rate) as p, exp(-_part_rate) as c)),
                   (t, k) -> array_append(t, struct(
                     element_at(t, -1).p * _part_rate / k as p,
                     element_at(t, -1).c + element_at(t, -1).p * _part_rate / k as c))),
                 x -> x.c)"""
        ),
    ).select("_source", "_parts", "_cdf")


def _uniform(*what: object) -> F.Column:
    """A number strictly between 0 and 1 from the first 52 bits of an MD5."""
    digest = F.md5(F.concat_ws("|", *[x if isinstance(x, F.Column) else F.lit(str(x)) for x in what]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    alpha: float = 0.5,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The columns of docs, `copy` (from 1) and `shuffle_key` (hex); rows in shuffled order."""
    rates = checkpoint(_with_distribution(source_rates(docs, weights, alpha, source_col, text_col)))
    names = [c for c in docs.columns if c not in (COPY, KEY)]
    ident = F.coalesce(F.col(f"_doc.{id_col}").cast("string"), F.md5(F.coalesce(F.col(f"_doc.{text_col}"), F.lit(""))))
    held = docs.select(F.struct(*map(quoted, names)).alias("_doc")).withColumn("_ident", ident)
    joined = held.join(small(rates), F.col(f"_doc.{source_col}").eqNullSafe(F.col("_source")))
    below = lambda u: F.size(F.filter("_cdf", lambda c: c < u))
    copies = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")),
        F.lit(0),
        lambda n, part: n + below(_uniform(seed, F.col("_ident"), part.cast("string"))),
    )
    many = joined.select("_doc", "_ident", copies.alias("_n")).where("_n > 0").select("_doc", "_ident", F.explode(F.sequence(F.lit(1), "_n")).alias(COPY))
    keyed = many.withColumn(KEY, F.md5(F.concat_ws("|", F.lit(f"shuffle{seed}"), "_ident", F.col(COPY).cast("string"))))
    dealt = keyed.repartition(F.col(KEY)).sortWithinPartitions(KEY)
    return dealt.select(*[F.col(f"_doc.{quoted(c)}").alias(c) for c in names], COPY, KEY)


def quality_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, weight: the root of a source's size times the share of good ones among its labelled documents (one good and one bad added)."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), (F.coalesce(F.length(text_col), F.lit(0)).cast("long") + 1).alias("_size"))
    judged = labels.groupBy(F.col(id_col).alias("_of")).agg(F.max("quality").alias("_quality"))
    per_source = slim.join(judged, F.col("_id") == F.col("_of"), "left").groupBy("source")
    share = (F.count_if(F.col("_quality") == 1) + 1).cast("double") / (F.count("_quality") + 2).cast("double")
    return per_source.agg((F.sqrt(F.sum("_size").cast("double")) * share).alias("weight"))


#: DuckDB: mix(documents, quality_weights(documents, labels)).
ORACLE_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0) + 1) AS BIGINT) AS size, CAST(count(*) FILTER (q = 1) + 1 AS DOUBLE) / CAST(count(q) + 2 AS DOUBLE) AS good
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id GROUP BY source),
weights AS (SELECT source, size, sqrt(CAST(size AS DOUBLE)) * good AS weight FROM sizes),
rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM weights) * CAST((SELECT sum(size) FROM weights) AS DOUBLE) / CAST(size AS DOUBLE) AS rate FROM weights),
parts AS (SELECT source, CAST(greatest(1, ceil(rate / 64.0)) AS INTEGER) AS n_parts, rate / greatest(1, ceil(rate / 64.0)) AS r FROM rates),
cdf AS (
  SELECT source, n_parts, r, 0 AS k, exp(-r) AS p, exp(-r) AS c FROM parts
  UNION ALL
  SELECT source, n_parts, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM cdf WHERE k < ceil(r + 12 * sqrt(r) + 30)),
cdfs AS (SELECT source, n_parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, n_parts),
draws AS (
  SELECT d.*, coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, ''))) AS ident, s.cs, unnest(range(1, s.n_parts + 1)) AS part
  FROM documents d JOIN cdfs s ON d.source IS NOT DISTINCT FROM s.source),
counts AS (
  SELECT doc_id, text, lang, source, n_chars, ident,
         CAST(sum(len(list_filter(cs, lambda c: c < (CAST(CAST('0x' || substr(md5('42|' || ident || '|' || part), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0))) AS BIGINT) AS n
  FROM draws GROUP BY ALL),
copies AS (SELECT *, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM counts WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, copy, md5('shuffle42|' || ident || '|' || copy) AS shuffle_key FROM copies
"""
