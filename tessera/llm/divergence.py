"""How far sources of a language differ in their words: a baseline for every pair, corrected by an inverted index.

A source's share of a term depends only on its count, so each pair of sources starts at V times the divergence of two
zero counts, as if no term occurred in either. What does occur corrects that. A count that occurs in one of the two
changes a pair by the same amount for all terms of that count, so terms of a source are first grouped by count and each group
corrects every partner once, weighted. Where both have a term, its postings correct the pair by what the two
one-sided corrections leave. Only sources named in a term's postings meet there, in blocks of BLOCK postings, so that no row and
no task holds all postings of a term; a correction of zero isn't emitted.

Shares are whole numbers out of SCALE, computed by long division, exact for up to 9e15 words a language; the values of a
pair add up to at most 2 * (SCALE + V), so sums of 64 bits are exact.

Defined cases: null text, language and source count as ''; a language without a kept term gives its pairs the value 0 and no
terms; rows with one doc_id are documents of their own, null ids as well; ties are split by the item's bytes; a language with a single
source has no pairs; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, documents

#: Documents of its language that a term occurs in to be kept.
LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
MOST_TERMS = 10
#: Different words of a task after which its counts are handed on.
HELD_TERMS = 1 << 19
#: Sources of one block of a term's postings.
BLOCK = 128
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): words of documents, added up in the task; a null term stands for the group itself."""
    held, size = defaultdict(lambda: (Counter(), Counter())), 0
    for b in batches:
        for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            words, docs = held[lang, source]
            found, before = Counter(text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()), len(words)
            words.update(found)
            docs.update(found.keys())
            size += len(words) - before
        if size > HELD_TERMS:
            yield from _emit(held)
            held.clear()
            size = 0
    yield from _emit(held)


def _emit(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (words, docs) in held.items():
        terms = [None, *words]
        columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *words.values()], pa.int64()), pa.array([0, *(docs[t] for t in words)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of each term of each group, and a row with a null term of each group."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = read.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, v: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * v)) in three steps of long division by 1000, each within 64 bits."""
    over, rest, said = f"({total} + 2 * {v})", f"({n} + 2)", "1L"
    for power in (1_000_000, 1000, 1):
        said += f" + ({rest} * 1000L div {over}) * {power}L"
        rest = f"({rest} * 1000L % {over})"
    return F.expr(said)


def apart(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))"


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups as (lang, source, zero, v, block): the share of a zero count (null where V is 0), V and a block number; and postings of kept
    terms as (lang, source, term, n, p, zero, q): counts and shares in the group, and the share of the term in its language."""
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.keep(term_counts(docs), "counts")
    words = counts.where(F.col("term").isNotNull())
    kept = words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs")
    kept = scratch.keep(kept, "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    postings = scratch.keep(words.drop("docs").join(kept, ["lang", "term"]), "postings")
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), "lang_total")
    groups = groups.withColumn("zero", F.when(F.col("v") > 0, share("0", "total", "v"))).withColumn("block", F.pmod(F.xxhash64("source"), F.lit(1 << 30)))
    groups = scratch.keep(groups, "groups", few=True)
    n_blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    groups = groups.join(n_blocks, "lang").withColumn("block", F.col("block") % F.col("blocks"))
    groups = scratch.keep(groups, "blocks", few=True)
    shared = postings.join(groups, ["lang", "source"])
    shared = shared.select("lang", "source", "term", "n", "zero", "block", share("n", "total", "v").alias("p"), share("lang_n", "lang_total", "v").alias("q"))
    return groups, scratch.keep(shared, "shares")


def _one_sided(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(a, b, value) of pairs a < b of sources: the baseline, and what the counts of one of them alone correct."""
    base = groups.select("lang", "source", "zero", F.lit(None).cast("long").alias("p"), F.lit(1).cast("long").alias("weight"), "v", "blocks")
    by_count = postings.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("weight"))
    by_count = by_count.join(groups.select("lang", "source", "v", "blocks"), ["lang", "source"])
    emitting = base.unionByName(by_count.select(*base.columns)).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).drop("blocks")
    partners = groups.select("lang", "block", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    met = emitting.join(partners, ["lang", "block"]).where((F.col("source") < F.col("other")) | (F.col("p").isNotNull() & (F.col("source") > F.col("other"))))
    start = f"v * ({apart('zero', 'other_zero')})"
    change = f"weight * (({apart('p', 'other_zero')}) - ({apart('zero', 'other_zero')}))"
    value = F.coalesce(F.expr(f"if(p is null, {start}, {change})"), F.lit(0))
    out = met.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), value.alias("value"), F.col("p").isNull().alias("base"))
    return out.where(F.col("base") | (F.col("value") != 0)).drop("base")


def _two_sided(postings: DataFrame) -> DataFrame:
    """(a, b, value) of pairs a < b that both have a term: what the two one-sided corrections leave to correct."""
    said = F.struct("source", "p", "zero")
    blocks = postings.groupBy("lang", "term", "block").agg(F.collect_list(said).alias("members"))
    left, right = blocks.withColumnRenamed("members", "here"), blocks.select("lang", "term", F.col("block").alias("other_block"), F.col("members").alias("there"))
    met = left.join(right, ["lang", "term"]).where("block <= other_block")
    met = met.select("lang", (F.col("block") == F.col("other_block")).alias("same"), F.explode("here").alias("x"), "there")
    met = met.select("lang", "same", "x", F.explode("there").alias("y")).where("x.source <> y.source and (not same or x.source < y.source)")
    value = F.expr(f"({apart('x.p', 'y.p')}) - ({apart('x.p', 'y.zero')}) - ({apart('x.zero', 'y.p')}) + ({apart('x.zero', 'y.zero')})")
    return met.select("lang", F.least("x.source", "y.source").alias("a"), F.greatest("x.source", "y.source").alias("b"), value.alias("value")).where("value <> 0")


def _ranked(found: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: each source's other sources by divergence, and its own foremost terms."""
    groups, postings = index(docs)
    pairs = _one_sided(groups, postings).unionByName(_two_sided(postings)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    pairs = pairs.select("lang", "value", ways).select("lang", "way.source", "way.item", "value")
    terms = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value"))
    return _ranked(pairs, "pair").unionByName(_ranked(terms, "term").where(F.col("rank") <= MOST_TERMS))


_P = f"(1 + {SCALE}::HUGEINT * ({{n}} + 2) // ({{total}} + 2 * v))"
_F = "((({p}) - ({q})) * (({p}) - ({q})) // (({p}) + ({q})))"

#: The same from the dense table of counts, in DuckDB.
OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), said AS (
  SELECT no, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM said GROUP BY lang, term HAVING count(DISTINCT no) >= {LEAST_DOCUMENTS}
), lang AS (SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS lang_total FROM kept GROUP BY lang
), grp AS (SELECT DISTINCT lang, source FROM docs
), counted AS (SELECT lang, source, term, count(*) AS n FROM said GROUP BY lang, source, term
), dense AS (
  SELECT g.lang, g.source, k.term, v, lang_n, lang_total, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM grp g JOIN kept k USING (lang) JOIN lang USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n, {_P.format(n="n", total="total")} AS p, {_P.format(n="lang_n", total="lang_total")} AS q FROM dense
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum({_F.format(p="a.p", q="b.p")}) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT 'pair' AS part, a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT 'term', lang, source, term, {_F.format(p="p", q="q")}::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))
