"""Removal of repeated byte strings by a multi-document suffix array, built column by column.

A byte is removed if a string of 100 bytes that covers it also starts earlier: in a smaller doc_id, or in the same
document before. To find such strings without sorting all suffixes of the corpus, every window of 100 bytes is dealt
by its anchor, the least hash among its short runs of bytes, which equal windows share. Neighbouring windows of one
anchor make a piece. Pieces whose anchor is met once can't repeat and are dropped; equal pieces are kept once, with
their first place, and neighbouring copies of one document's pieces are claimed as one run, whose bytes are removed
only if they have the SHA-256 of the bytes that they are said to repeat. The different pieces of an anchor are cut in
two, by the longer cores that their windows share around it; those that share a core meet in one task, which builds
their joint suffix order: each round puts one more symbol in front of every piece's last suffix, as the occurrences of
that symbol in the Burrows-Wheeler transform, read in order, say where the longer suffixes stand, and updates the
common prefixes of neighbours. The bytes of a core, compared one by one, are one symbol of as many bytes. Runs of
common prefix 100 or more are equal windows, of which all but the first are repeats.

The transform, the common prefixes and the owners are sequential arrays rewritten once a round; a batch of pieces is
bounded, so they stay in memory in place of external files. Pieces of a core that no batch holds (a line shorter than
a window among ever different neighbours) are grouped by the bytes of their windows, which is the same result.

Defined cases: null reads as the empty text; texts under 100 bytes lose nothing; rows with equal doc_id are ordered
by their text's digest; a null doc_id comes first; repeated rows lose all but the first; an empty table gives an
empty result; extra columns are ignored; texts are read whole, however long, in overlapping parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import VALUE, Scratch, documents, mix, power_tables, short_batches

LENGTH = 100
#: Bytes of an anchor; a window has LENGTH - ANCHOR + 1 of them.
ANCHOR = 44
#: Bytes of one part of a text, and of the pieces in a batch.
PART, BATCH = 1 << 20, 1 << 18
#: Different pieces of a core that one batch holds; a core of more is grouped by the bytes of its windows.
HELD = 4096
#: Bytes of the core that half of a piece's windows share: the anchor with as many bytes after it, or before it, as
#: lie within all of those windows.
SPAN = (LENGTH - ANCHOR) // 2
CORE = ANCHOR + SPAN
_KEY_BITS = np.uint64(48)


def _hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size bytes."""
    up, down = power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((VALUE[raw] + raw.astype(np.uint64)) * down[: len(raw)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * up[: len(raw) - size + 1])


def _part_pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor keys, first windows and numbers of windows of the pieces of one part."""
    own = _hashes(raw, ANCHOR)
    place = np.uint64(24)
    least = (own >> place << place) | np.arange(len(own), dtype=np.uint64)  # ties: the leftmost
    width, have = LENGTH - ANCHOR + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: -(width - have)], least[width - have :])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return own[at[first]] >> (np.uint64(64) - _KEY_BITS), first, np.diff(np.concatenate([first, [len(at)]]))


def piece_keys(raw: np.ndarray) -> np.ndarray:
    """The anchor keys of a text's pieces."""
    starts = range(0, max(0, len(raw) - LENGTH + 1), PART)
    return np.concatenate([np.zeros(0, np.uint64), *(_part_pieces(raw[at : at + PART + LENGTH - 1])[0] for at in starts)])


def halves(raw: np.ndarray, own: np.ndarray, at: int, n: int) -> Iterator[tuple[int, int, int, bytes]]:
    """A piece's windows in two parts by where its anchor is: the hash of the part's core, where it is, its first window, its bytes.

    All windows of a part hold the whole core, so equal windows are in parts of one core.
    """
    anchor = at + n - 1 + int(np.argmin(own[at + n - 1 : at + LENGTH - ANCHOR + 1]))
    for side, first, last, core in ((0, max(at, anchor - SPAN + 1), at + n - 1, anchor), (1, at, min(at + n - 1, anchor - SPAN), anchor - SPAN)):
        if first <= last:
            digest = hashlib.blake2b(raw[core : core + CORE].tobytes(), digest_size=8, person=bytes([side])).digest()
            yield int.from_bytes(digest, "little", signed=True), core - first, first, raw[first : last + LENGTH].tobytes()


def pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, digests, first windows and numbers of windows of a text's pieces."""
    out = []
    for at in range(0, max(0, len(raw) - LENGTH + 1), PART):
        part = raw[at : at + PART + LENGTH - 1]
        key, first, count = _part_pieces(part)
        up, down = power_tables(len(part) + 1)
        sums = np.zeros((2, len(part) + 1), np.uint64)
        np.cumsum((VALUE[part] + part.astype(np.uint64)) * down[: len(part)], out=sums[0, 1:])
        end = first + count + LENGTH - 1
        digest = mix((sums[0, end] - sums[0, first]) * up[first] + (count.astype(np.uint64) << np.uint64(32)))
        out.append((key, digest, first + at, count))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def suffix_order(parts: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, starts and common prefixes of all suffixes in order, built a column a round.

    A symbol counts as many bytes of a common prefix as weights say, or one.

    Round j extends every suffix of j - 1 symbols, so all suffixes of j or fewer symbols stand in order after it. The
    new order is the old one dealt by preceding symbol, occurrences of a symbol keeping their order. A suffix's
    common prefix with the one before it is one more than the least common prefix between the two places that they
    come from; suffixes that were in order before keep theirs unless a new one came between.
    """
    n, size = len(parts), np.array([len(p) for p in parts], np.int64)
    most = max((int(p.max()) for p in parts if len(p)), default=0)
    kind = np.uint8 if most < 255 else np.uint16 if most < 65535 else np.uint32
    weight = np.ones(most + 2, np.int16)
    if weights is not None:
        weight[1 : len(weights) + 1] = weights[: most + 1]
    flat = np.zeros(int(size.sum()) + n + 1, kind)  # a 0 before each part and after the last
    ends = np.cumsum(size + 1)
    for p, end in zip(parts, ends, strict=True):
        flat[end - len(p) : end] = p.astype(kind) + 1
    # In order so far: only the empty suffixes, each at its part's end. fresh: those that the last round put in.
    empty = ends.astype(np.int32)
    at, lcp, fresh = empty, np.zeros(n, np.int16), np.ones(n, bool)
    for _ in range(int(size.max())):
        before = flat[at - 1]
        order = np.argsort(before, kind="stable")[np.count_nonzero(before == 0) :]
        symbol, new = before[order], fresh[order]
        if not new.any():
            break
        same = np.concatenate([[False], symbol[1:] == symbol[:-1]])
        then = np.zeros(len(order), np.int16)
        then[~new] = lcp[n:]
        moved = new | np.concatenate([[False], new[:-1]])
        then[moved] = 0
        i = np.flatnonzero(moved & same)
        then[i] = weight[symbol[i]] + _least_between(lcp, order[i - 1], order[i])
        at = np.concatenate([empty, at[order] - 1]).astype(np.int32)
        lcp, fresh = np.concatenate([np.zeros(n, np.int16), then]), np.concatenate([np.zeros(n, bool), new])
    who = np.searchsorted(ends, at)
    return who, at - (ends - size)[who], lcp


def _least_between(values: np.ndarray, left: np.ndarray, right: np.ndarray, far: int = 1024) -> np.ndarray:
    """min(values[left + 1 : right + 1]) for each pair: by doubling over the distances that occur, far ones singly."""
    out = np.empty(len(left), values.dtype)
    gap = right - left
    table, span = values, 1
    todo = np.flatnonzero(gap < far)
    while len(todo):
        # Intervals of span..2 * span - 1 values are covered by two overlapping runs of span values.
        now = gap[todo] < 2 * span
        i = todo[now]
        out[i] = np.minimum(table[left[i] + 1], table[right[i] - span + 1])
        todo = todo[~now]
        if len(todo):
            table = np.minimum(table[:-span], table[span:])
            span *= 2
    for i in np.flatnonzero(gap >= far):
        out[i] = values[left[i] + 1 : right[i] + 1].min()
    return out


def repeats(parts: list[np.ndarray], core_at: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """For pieces first met at (doc, at), with a core at core_at: starts and ends of the runs of windows that are met earlier elsewhere."""
    cores: dict[bytes, int] = {}
    coded = []
    for p, k in zip(parts, core_at, strict=True):
        core = cores.setdefault(p[k : k + CORE].tobytes(), 256 + len(cores))
        coded.append(np.concatenate([p[:k], [core], p[k + CORE :]]).astype(np.uint32))
    who, start, lcp = suffix_order(coded, np.concatenate([np.ones(256, np.int16), np.full(len(cores), CORE, np.int16)]))
    size = np.array([len(p) for p in parts])
    window = (start <= core_at[who]) & (size[who] - start >= LENGTH)
    # Runs of equal windows: a window whose common prefix with the entry before is shorter opens a run.
    who, start, lcp = who[window], start[window], lcp[window]
    opens = lcp < LENGTH
    run = np.cumsum(opens) - 1
    ranks = np.unique(doc, return_inverse=True)[1].astype(np.int64)
    place = (ranks[who] << 32) + at[who] + start
    first = np.full(run[-1] + 1 if len(run) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, run, place)
    again = place != first[run]
    out: list[list[int]] = [[] for _ in parts]
    order = np.lexsort((start[again], who[again]))
    w, s = who[again][order], start[again][order]
    if len(w):
        cut = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (s[1:] != s[:-1] + 1)]))
        for a, b in zip(cut, np.concatenate([cut[1:], [len(w)]]), strict=True):
            out[w[a]] += [int(s[a]), int(s[b - 1]) + 1]
    return out


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """row, doc_id and text of different rows, and how often each row is met if any is met again.

    row orders the rows: it is doc_id itself where that tells all apart, else their place by (doc_id, digest).
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if rows.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").isEmpty():
        return rows.withColumn("row", F.col("doc_id")), None
    rows = rows.groupBy("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    rows = scratch.keep(rows, "rows")
    # Ids rise with the partitions of a sorted table, and within them.
    places = rows.select("doc_id", "digest", "copies").sort(F.asc_nulls_first("doc_id"), "digest").withColumn("row", F.monotonically_increasing_id())
    places = scratch.keep(places, "places")
    named = rows.join(places.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "row"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")))
    return scratch.keep(named.select("doc_id", "text", "row"), "numbered"), places.select("row", "copies")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept text of each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    ids, copies = _numbered(docs, scratch)
    rows = ids.select(F.col("row").alias("doc_id"), "text")
    short_batches(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pieces(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)) for t in b.column(1).to_pylist()]
            arrays = [pa.array([f[i].astype(k) for f in found], pa.list_(t)) for i, k, t in ((0, np.int64, pa.int64()), (1, np.int64, pa.int64()), (2, np.int32, pa.int32()), (3, np.int32, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "key", "digest", "at", "n"])

    def cut_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [piece_keys(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)).astype(np.int64) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], ["key"])

    cuts = rows.mapInArrow(cut, "doc_id long, key array<long>, digest array<long>, at array<int>, n array<int>")
    keys = rows.select("text").mapInArrow(cut_keys, "key long").groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    keys = scratch.keep(keys, "keys")
    spread = cuts.select("doc_id", F.inline(F.arrays_zip("key", "digest", "at", "n")))
    met = scratch.keep(spread.join(keys, "key"), "met")
    scratch.drop(keys)
    # Equal pieces once, with their first place; then anchors that have several different ones.
    lead = met.groupBy("key", "digest").agg(F.min(F.struct("doc_id", "at")).alias("lead"), F.first("n").alias("n"), F.count("*").alias("copies"))
    lead = scratch.keep(lead.select("key", "digest", "lead.doc_id", "lead.at", "n", "copies"), "lead")
    several = lead.groupBy("key").agg(F.count("*").alias("forms")).where("forms > 1").select("key")
    wanted = lead.join(several, "key").select("doc_id", F.struct("at", "n").alias("p")).groupBy("doc_id").agg(F.collect_list("p").alias("p"))
    # Copies of pieces, run together where their neighbours repeat the neighbours of the same piece.
    again = met.join(lead.where("copies > 1").select("key", "digest", F.col("doc_id").alias("d"), F.col("at").alias("a")), ["key", "digest"])
    again = again.where((F.col("doc_id") != F.col("d")) | (F.col("at") != F.col("a"))).select("doc_id", "at", "n", "d", "a")
    order_of = Window.partitionBy("doc_id").orderBy("at")
    before = lambda c: F.lag(c).over(order_of)
    goes_on = (before("d") == F.col("d")) & (before("at") + before("n") == F.col("at")) & (before("a") + before("n") == F.col("a"))
    again = again.withColumn("opens", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("opens").over(order_of.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    claims = again.groupBy("doc_id", "run").agg(F.min("at").alias("at"), F.first("d").alias("d"), F.min("a").alias("a"), (F.sum("n") + LENGTH - 1).cast("int").alias("size"))
    claims = scratch.keep(claims.drop("run"), "claims")
    asked = claims.select("d", "a", "size").distinct().groupBy(F.col("d").alias("doc_id")).agg(F.collect_list(F.struct("a", "size")).alias("v"))

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "doc_id", "at", "piece", "core", "size"], (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
        for b in batches:
            out = []
            for doc_id, text, wanted, asked in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                own = _hashes(raw, ANCHOR)
                for p in wanted or ():
                    out += [(key, doc_id, first, piece, core, None) for key, core, first, piece in halves(raw, own, p["at"], p["n"])]
                out += [(None, doc_id, v["a"], hashlib.sha256(raw[v["a"] : v["a"] + v["size"]]).digest(), None, v["size"]) for v in asked or ()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    requests = wanted.join(asked, "doc_id", "full")
    forms = scratch.keep(rows.join(requests, "doc_id").select("doc_id", "text", "p", "v").mapInArrow(parts_of, "key long, doc_id long, at int, piece binary, core int, size int"), "forms")
    answers = forms.where("key is null").select(F.col("doc_id").alias("d"), F.col("at").alias("a"), "size", F.col("piece").alias("sha"))
    cores = scratch.keep(forms.where("key is not null").groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "cores")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[tuple]) -> pa.RecordBatch:
            _, doc, at, piece, core = zip(*held, strict=True)
            found = repeats([np.frombuffer(p, np.uint8) for p in piece], np.array(core, np.int64), np.array(doc), np.array(at, np.int64))
            kept = [(d, [v + k + (LENGTH - 1) * (i % 2) for i, v in enumerate(x)]) for d, k, x in zip(doc, at, found, strict=True) if x]
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.list_(pa.int32()))], ["doc_id", "marks"])

        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and size >= BATCH and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield done(held)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cold = forms.join(cores.where(F.col("c") <= HELD).select("key"), "key").select("key", "doc_id", "at", "piece", "core").repartition(tasks, "key").sortWithinPartitions("key")
    runs = cold.mapInArrow(order, "doc_id long, marks array<int>")
    # Cores that no batch holds: their windows, grouped with map-side aggregation.
    large = forms.join(cores.where(F.col("c") > HELD).select("key"), "key")
    spots = large.select("doc_id", "at", "piece", F.explode(F.expr(f"sequence(1, octet_length(piece) - {LENGTH - 1})")).alias("k"))
    spots = spots.select(F.struct("doc_id", (F.col("at") + F.col("k") - 1).alias("at")).alias("spot"), F.substring("piece", F.col("k"), F.lit(LENGTH)).alias("w"))
    first = spots.groupBy("w").agg(F.min("spot").alias("first"), F.count("*").alias("c")).where("c > 1")
    later = spots.join(first, "w").where("spot <> first").select("spot.doc_id", F.array(F.col("spot.at"), F.col("spot.at") + LENGTH).alias("marks"))
    # A piece's first place loses the windows that others have earlier; its other places lose all.
    marks = runs.unionByName(later).groupBy("doc_id").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    marks = scratch.keep(marks, "marks")
    scratch.drop(cores)
    claimed = claims.join(answers, ["d", "a", "size"], "left").groupBy("doc_id").agg(F.collect_list(F.struct("at", "size", "sha")).alias("claims"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        for b in batches:
            out = []
            bounds, all_marks = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy()
            for k, (doc_id, text, claims) in enumerate(zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True)):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                found = all_marks[bounds[k] : bounds[k + 1]]
                gone = np.zeros(len(raw) + 1, np.int64)
                np.add.at(gone, found[::2], 1)
                np.add.at(gone, found[1::2], -1)
                for claim in claims or ():
                    at, end = claim["at"], claim["at"] + claim["size"]
                    if hashlib.sha256(raw[at:end]).digest() != claim["sha"]:
                        raise RuntimeError("different strings have one digest")
                    gone[at] += 1
                    gone[end] -= 1
                covered = np.cumsum(gone)[:-1] > 0
                kept = raw[~covered].tobytes()
                spans = int((np.diff(np.concatenate([[0], covered.astype(np.int8)])) == 1).sum())
                out.append((doc_id, len(raw), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    joined = ids.join(marks.join(claimed, "doc_id", "full").withColumnRenamed("doc_id", "of"), F.col("row") == F.col("of"), "left")
    joined = joined.select("doc_id", "text", F.coalesce("marks", F.array().cast("array<int>")).alias("marks"), "claims")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    if copies is None:
        return joined.mapInArrow(strip, schema)
    # Rows that are met again: all that can be removed of those after the first is.
    extra = copies.where("copies > 1").select("row", F.explode(F.expr("sequence(2L, copies)")))
    whole = ids.join(extra, "row").select("doc_id", "text", F.when(F.octet_length("text") < LENGTH, F.array().cast("array<int>")).otherwise(F.array(F.lit(0), F.octet_length("text"))).alias("marks"), F.lit(None).cast(joined.schema["claims"].dataType).alias("claims"))
    return joined.unionByName(whole).mapInArrow(strip, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
