"""A Merkle manifest of a dataset: leaves ranked by a radix trie of ids, nodes reduced from the longest prefix up.

An id's path is its sixteen hexadecimal digits, of an unsigned number in the order of ids. Counts are taken by all but
its last two digits and rolled up by shorter and shorter prefixes; on the way down a prefix starts where its
neighbours of smaller digits end. So every bucket of 256 ids knows its first rank without a sort of all rows, and rows
are sorted within buckets alone. Where ids repeat so often that a bucket holds more than BUCKET_ROWS, its paths go on
with the last two digits and four of the leaf's digest.

Ranks written in base FANOUT key the nodes of a trie: the node of a prefix is the hash of the nodes that extend it by one
digit. A task takes the nodes below one prefix that is CHUNK_DIGITS shorter and reduces the longest prefixes
first; what is left of each such chunk is a node of the next round. Proofs come back the other way: a
chunk's path to the root is joined to it and its rows extend it, so no row carries a proof through a shuffle.

Defined cases: nulls of the hashed columns count as `-`; a null doc_id comes first and is never tampered with; rows that share a
doc_id are ordered by their leaves, and equal rows, which have equal leaves, are leaves of their own next to each other;
languages are few, and their subroots are ranked by one window; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, crc_bucket, documents

#: Nodes that become one.
FANOUT = 2
#: Digits of a rank by which one round shortens prefixes.
CHUNK_DIGITS = 6
#: Rows of a bucket of 256 ids from which on it is parted by digests too.
BUCKET_ROWS = 1024
#: Lengths of an id's prefixes, with four digits of the leaf at the end, down to the null mark alone.
PREFIXES = (21, 17, 15, 11, 7, 3, 1)
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
#: Of a bucket of ids in seven, one is tampered with.
TAMPERED = 7


def leaf(row: dict[str, Column]) -> Column:
    """The hash of a row: its values in turn, each `-` or its length in bytes, a colon and itself."""
    said = [row[c].cast("string") for c in HASHED]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): tampered is the leaf of the row with n_chars one higher where it is tampered with, else null."""
    row = {c: F.col(c) for c in HASHED}
    changed = leaf(row | {"n_chars": row["n_chars"] + 1})
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf(row).alias("leaf"), F.when(crc_bucket(F.col("doc_id"), TAMPERED) == 0, changed).alias("tampered"))


def _path(doc_id: Column) -> Column:
    """An id as text in the order of ids: a mark, null first, and sixteen digits."""
    return F.when(doc_id.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))


def ranked(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """rows of (grp, doc_id, leaf, ...) with the rank of each in its grp by doc_id, then leaf, from 0."""
    rows = rows.withColumn("path", _path(F.col("doc_id"))).withColumn("bucket", F.substring("path", 1, PREFIXES[2]))
    crowded = rows.groupBy("grp", "bucket").count().where(F.col("count") > BUCKET_ROWS).select("grp", "bucket", F.lit(True).alias("crowded"))
    rows = rows.join(crowded, ["grp", "bucket"], "left")
    rows = rows.withColumn("bucket", F.when(F.col("crowded"), F.concat("path", F.substring("leaf", 1, 4))).otherwise(F.col("bucket"))).drop("crowded")
    finest = scratch.keep(rows.groupBy("grp", "bucket").agg(F.count("*").alias("n")), "histogram", few=True)
    starts = None
    for length, shorter in zip(reversed(PREFIXES), [0, *reversed(PREFIXES[1:])], strict=True):
        level = finest.groupBy("grp", F.substring("bucket", 1, length).alias("bucket")).agg(F.sum("n").alias("n"))
        above = F.substring("bucket", 1, shorter)
        before = F.coalesce(F.sum("n").over(Window.partitionBy("grp", above).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        level = level.select("grp", "bucket", before.alias("before"), above.alias("above"))
        if starts is not None:
            level = level.join(starts.select("grp", F.col("bucket").alias("above"), F.col("start").alias("start_above")), ["grp", "above"])
        starts = level.select("grp", "bucket", (F.col("before") + (F.lit(0) if starts is None else F.col("start_above"))).alias("start"))
    within = F.row_number().over(Window.partitionBy("grp", "bucket").orderBy("path", "leaf"))
    return rows.withColumn("within", within - 1).join(starts, ["grp", "bucket"]).withColumn("rank", F.col("start") + F.col("within")).drop("bucket", "path", "within", "start")


def _levels(n: Column) -> Column:
    """Times that n nodes are to be reduced until one is left."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.pow(F.lit(float(FANOUT)), i) < n))


def _chunk(nodes: DataFrame, rest: list[str]) -> DataFrame:
    """(grp, n, chunk, members): the nodes below each prefix, in order."""
    width = FANOUT**CHUNK_DIGITS
    members = F.array_sort(F.collect_list(F.struct("rank", "hash", *rest)))
    return nodes.groupBy("grp", "n", F.expr(f"rank div {width}").alias("chunk")).agg(members.alias("members"))


def _reduce(chunks: DataFrame, step: int) -> DataFrame:
    """chunks with depth, how many digits their prefixes lose in this round, and levels, the hashes of the nodes after 0 to depth digits."""
    depth = F.greatest(F.lit(0), F.least(F.lit(CHUNK_DIGITS), _levels(F.col("n")) - CHUNK_DIGITS * step))
    last = "element_at(done, -1)"
    runs = f"transform(sequence(0, cast((size({last}) - 1) div {FANOUT} as int)), i -> sha2(array_join(slice({last}, i * {FANOUT} + 1, {FANOUT}), ''), 256))"
    return chunks.withColumn("depth", depth).withColumn("levels", F.expr(f"aggregate(array_repeat(0, depth), array(members.hash), (done, z) -> array_append(done, {runs}))"))


def _members(rest: list[str]) -> Column:
    """A chunk's members, each with what stands left and right of its node at each of the chunk's levels."""
    at = f"cast(floor(m.rank % {FANOUT**CHUNK_DIGITS} / power({FANOUT}, k)) as int)"
    left, right = f"slice(level, {at} - {at} % {FANOUT} + 1, {at} % {FANOUT})", f"slice(level, {at} + 2, {FANOUT - 1} - {at} % {FANOUT})"
    own = f"transform(slice(levels, 1, depth), (level, k) -> named_struct('l', array_join({left}, ''), 'r', array_join({right}, '')))"
    kept = "".join(f", '{c}', m.{c}" for c in rest)
    return F.expr(f"transform(members, m -> named_struct('rank', m.rank, 'hash', m.hash, 'own', {own}{kept}))")


def _up(scratch: Scratch, nodes: DataFrame, rest: list[str], most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The chunks of every round, written, and (grp, n, hash) of what remains of each grp whose nodes are ranked from 0 to n - 1; most: the largest n."""
    kept = []
    while True:
        kept.append(scratch.keep(_chunk(nodes, rest if not kept else []), f"{name}-{len(kept)}"))
        nodes = _reduce(kept[-1], len(kept) - 1).select("grp", "n", F.col("chunk").alias("rank"), F.expr("element_at(levels, -1)[0]").alias("hash"))
        most = -(-most // FANOUT**CHUNK_DIGITS)
        if most <= 1:
            return kept, nodes.select("grp", "n", "hash")


def _down(kept: list[DataFrame], tops: DataFrame, rest: list[str]) -> DataFrame:
    """(grp, rank, hash, *rest, pairs, *columns of tops): every node of the first round with the siblings on its way up to
    those pairs that tops has of its grp."""
    more = [c for c in tops.columns if c not in ("grp", "pairs")]
    above = tops.select("grp", F.lit(0).cast("long").alias("chunk"), "pairs", *more)
    for step in reversed(range(len(kept))):
        own = rest if not step else []
        chunks = _reduce(kept[step], step).join(above, ["grp", "chunk"])
        nodes = chunks.select("grp", *more, F.col("pairs").alias("upper"), F.explode(_members(own)).alias("node"))
        pairs = F.concat("node.own", "upper").alias("pairs")
        if not step:
            return nodes.select("grp", "node.rank", "node.hash", *[f"node.{c}" for c in rest], pairs, *more)
        above = nodes.select("grp", F.col("node.rank").alias("chunk"), pairs, *more)
    raise AssertionError("a tree has a round")


def folded(start: Column, pairs: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(pairs, start, lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, lang, rank, leaf, subroot, root, proof_sha256, n_siblings, folded_root and verified of each row of docs."""
    scratch, rest = Scratch(docs.sparkSession, "manifest"), ["doc_id", "lang", "tampered"]
    rows = scratch.keep(leaves(docs).withColumn("grp", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))), "leaves")
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n"), F.count("*")).first()
    if not most[0]:
        most = (1, 1)
    nodes = ranked(scratch, rows).join(sizes, "grp").withColumnRenamed("leaf", "hash")
    kept, subroots = _up(scratch, nodes, rest, most[0], "nodes")
    # one node a language: few, so that one window ranks them
    subroots = scratch.keep(subroots, "subroots")
    top = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("lang_grp"), F.col("hash"), F.lit(most[1]).cast("long").alias("n"))
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy("lang_grp")).cast("long") - 1)
    over, root = _up(scratch, top, ["lang_grp"], most[1], "languages")
    root = root.select("grp", F.col("hash").alias("root"), F.array().cast("array<struct<l:string,r:string>>").alias("pairs"))
    tops = _down(over, root, ["lang_grp"]).select(F.col("lang_grp").alias("grp"), F.col("hash").alias("subroot"), "root", "pairs")
    out = _down(kept, tops, rest)
    proof = F.sha2(F.array_join(F.transform("pairs", lambda p: F.concat(p["l"], p["r"])), ""), 256)
    out = out.select("doc_id", "lang", "rank", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), F.size("pairs").alias("n_levels"), folded(F.coalesce("tampered", "hash"), F.col("pairs")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))



def _leaf_sql(n_chars: str) -> str:
    said = [f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(said)})"


#: The same tree in DuckDB, a level at a time; CRC-32 is taken bit by bit from its polynomial.
OP11_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars + 1)")} AS changed,
    list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, b: list_reduce([xor(crc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))) AS crc
  FROM documents
), ranked AS (
  SELECT doc_id, lang, leaf, CASE WHEN xor(crc, 4294967295::BIGINT) % {TAMPERED} = 0 THEN changed ELSE leaf END AS claimed, coalesce('=' || lang, '') AS grp,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM docs
), node AS (
  SELECT grp, 0 AS level, 1::BIGINT AS width, rank AS i, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM ranked
  UNION ALL
  SELECT grp, level + 1, any_value(width) * {FANOUT}, i // {FANOUT}, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + {FANOUT - 1}) // {FANOUT} FROM node WHERE n > 1 GROUP BY grp, level, i // {FANOUT}
), subroot AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS rank FROM node WHERE n = 1
), upper_node AS (
  SELECT 0 AS level, 1::BIGINT AS width, rank AS i, h, count(*) OVER () AS n FROM subroot
  UNION ALL
  SELECT level + 1, any_value(width) * {FANOUT}, i // {FANOUT}, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + {FANOUT - 1}) // {FANOUT} FROM upper_node WHERE n > 1 GROUP BY level, i // {FANOUT}
), step AS (
  SELECT r.grp, r.rank, x.level, x.i, x.h, r.rank // x.width AS own FROM ranked r JOIN node x ON x.grp = r.grp AND x.n > 1 AND x.i // {FANOUT} = r.rank // x.width // {FANOUT}
  UNION ALL
  SELECT r.grp, r.rank, 1000 + x.level, x.i, x.h, s.rank // x.width FROM ranked r JOIN subroot s USING (grp) JOIN upper_node x ON x.n > 1 AND x.i // {FANOUT} = s.rank // x.width // {FANOUT}
), pair AS (
  SELECT grp, rank, level, coalesce(string_agg(CASE WHEN i < own THEN h END, '' ORDER BY i), '') AS l, coalesce(string_agg(CASE WHEN i > own THEN h END, '' ORDER BY i), '') AS r FROM step GROUP BY grp, rank, level
), path AS (
  SELECT grp, rank, string_agg(l || r, '' ORDER BY level) AS proof, list(l || '|' || r ORDER BY level) AS pairs FROM pair GROUP BY grp, rank
), folded AS (
  SELECT x.*, coalesce(proof, '') AS proof, list_reduce([claimed] || coalesce(pairs, []), lambda h, p: sha256(split_part(p, '|', 1) || h || split_part(p, '|', 2))) AS folded_root, coalesce(len(pairs), 0)::INT AS n_levels
  FROM ranked x LEFT JOIN path USING (grp, rank)
)
SELECT doc_id, lang, rank, leaf, s.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, n_levels, folded_root, folded_root = u.h AS verified
FROM folded JOIN (SELECT grp, h FROM subroot) s USING (grp), (SELECT h FROM upper_node WHERE n = 1) u
"""


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))
