"""Source divergence audit by a baseline-correction inverted index (operator 13).

Within a language, each source's smoothed term shares p are compared with those of each other source: a pair's value is
f = floor((p - q)^2 / (p + q)) summed over all kept terms, whether a source has them or not. The index has a posting for
each (term, source) with a count; a pair isn't walked term by term:

* baseline: V times f of both sources' shares of a term they don't have;
* for each posting, what f changes against all sources without the term. That depends on the count alone, so a source's
  postings are gathered by count first, and each distinct count meets each other source once;
* for each two postings of one term, what is left: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

The three sum up to the exact value; terms that neither source has cost nothing. Beside the pairs, each source's terms that
stand out most against its language are ranked by window, at most `top` for each.

Tasks gather distinct (group, term) counts of whole texts in bounded arrays; terms are told apart by their bytes. One
shuffle brings a term's sources together, where those in fewer than `min_docs` documents of the language go. Shares are
whole numbers in billionths; products that outgrow 64 bits are decimals, so all arithmetic is exact.

Defined results: null text, lang and source are ''; every (lang, source) that occurs is compared, also without terms; a
language without kept terms has all values 0; a repeated row is a document of its own; a lone source has no pairs; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claraudit.llm.common import drop_path, forget, release, stage_path, staged
from claraudit.llm.terms import LETTERS, lower_ascii, remember, runs, strings, summed
from claraudit.llm.words import Remembered, Texts

MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
SLICE, TERM_BYTES, HELD_ROWS = 2 << 20, 48 << 20, 3 << 20
#: Parts in which a language's distinct counts meet its sources.
SALTS = 32


class _Counts:
    """(group, term) -> occurrences, documents."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known, self.groups = Remembered(), {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, groups: list[tuple[str, str]], part: Texts) -> None:
        p = runs(lower_ascii(part), LETTERS)
        code, rows = remember(self.known, p)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        each, n = np.unique(p.row_of() << 32 | code, return_counts=True)  # of each document
        self.parts.append(summed(group[each >> 32] << 32 | rows[each & 0xFFFFFFFF], n, np.ones(len(n), np.int64)))
        self.held += len(self.parts[-1][0])
        if self.held > HELD_ROWS:
            self._join()

    def _join(self) -> None:
        self.parts = [summed(*[np.concatenate(x) for x in zip(*self.parts, strict=True)])]
        self.held = len(self.parts[0][0])

    def full(self) -> bool:
        return self.held > HELD_ROWS // 2 and len(self.parts) == 1 or self.known.bytes() > TERM_BYTES

    def batches(self, size: int = 1 << 15) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._join()
            keys, n, docs = self.parts[0]
            names, k = list(self.groups), self.known
            for i in range(0, len(keys), size):
                some = keys[i : i + size]
                group, term = (some >> 32).tolist(), some & 0xFFFFFFFF
                columns = [pa.array([names[g][0] for g in group], pa.string()), pa.array([names[g][1] for g in group], pa.string()), strings(k.data, k.starts[term], k.lengths[term]), pa.array(n[i : i + size]), pa.array(docs[i : i + size])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        self.clear()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    counts = _Counts()
    for batch in batches:
        groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for a, part in Texts.of(batch.column(2)).parts(SLICE):
            counts.add(groups[a : a + len(part)], part)
            if counts.full():
                yield from counts.batches()
            release()
    yield from counts.batches()
    release(0)


def share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)); null without terms."""
    c, n, v = (F.col(x) if isinstance(x, str) else x for x in (count, total, terms))
    above = F.lit(UNIT).cast("decimal(10,0)") * (c.cast("decimal(19,0)") + 2)
    below = n.cast("decimal(19,0)") + 2 * v.cast("decimal(12,0)")
    return F.when(v > 0, 1 + F.call_function("div", above, below)).cast("long")


def distance(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / (p + q)) of shares up to UNIT + 1."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_index(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, source, n, total (n in the language), first (one posting of each kept term): the postings of kept terms."""
    counted = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # tasks have gathered already; dealt by term, a term's sources meet without another shuffle
    counted = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counted = counted.withColumn("in_docs", F.sum("docs").over(term)).withColumn("total", F.sum("n").over(term)).withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    return counted.filter(F.col("in_docs") >= min_docs).select("lang", "term", "source", "n", "total", "first")


def source_divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item (another source or a term), value, rank (from 1 in its part)."""
    spark = docs.sparkSession
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    docs, work = docs.select(*text), stage_path(spark, "divergence")
    postings = staged(term_index(docs, min_docs), "postings", f"{work}/postings")
    langs = postings.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("all_n"))
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["v", "own_n", "all_n"])
    groups = staged(groups.withColumn("p0", share(F.lit(0), "own_n", "v")), "groups", f"{work}/groups")
    # Spark broadcasts groups only where their measured size allows it
    index = postings.join(groups, ["lang", "source"]).withColumn("p", share("n", "own_n", "v"))

    a, b = groups.alias("a"), groups.alias("b")
    pair = [F.col("a.lang").alias("lang"), F.col("a.source").alias("x"), F.col("b.source").alias("y")]
    baseline = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source")))
    baseline = baseline.select(*pair, F.coalesce(F.col("a.v") * distance("a.p0", "b.p0"), F.lit(0)).alias("value"))

    by_count = index.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms"), F.first("p").alias("p"), F.first("p0").alias("p0"))
    by_count = by_count.withColumn("salt", F.pmod(F.xxhash64("source", "n"), F.lit(SALTS))).alias("a")
    others = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).alias("b")
    one_sided = by_count.join(others, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.source") != F.col("b.source")))
    change = F.col("a.terms") * (distance("a.p", "b.p0") - distance("a.p0", "b.p0"))
    one_sided = one_sided.select(F.col("a.lang").alias("lang"), F.least("a.source", "b.source").alias("x"), F.greatest("a.source", "b.source").alias("y"), change.alias("value"))

    slim = index.select("lang", "term", "source", "p", "p0")
    met = slim.alias("a").join(slim.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    both = met.select(*pair, (distance("a.p", "b.p") - distance("a.p", "b.p0") - distance("a.p0", "b.p") + distance("a.p0", "b.p0")).alias("value"))
    both = both.filter("value <> 0").groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))

    values = baseline.unionByName(one_sided).unionByName(both).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    pairs = values.select("lang", "value", ends.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    terms = index.withColumn("q", share("total", "all_n", "v")).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = staged(pairs.unionByName(terms), "divergences")
    drop_path(spark, work)
    return out


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


QUERIES = {"op13_source_divergence": op13_source_divergence}
SQL = {
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, sum(n) AS own_n FROM c JOIN k USING (lang, term) GROUP BY ALL),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(own_n, 0) + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (total + 2)) // (all_n + 2 * v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang
  LEFT JOIN o ON o.lang = g.lang AND o.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM x WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""
}
