"""Files as tables: validated reads, exact-content deduplication, dated paths and an encrypted store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import privacy
from tessera.sources import versions

# Bounds of an upload, and the shape of a stored path.
MAX_BYTES, MAX_PIXELS, LEAST_EDGE, MOST_EDGE = 10 * 1024 * 1024, 60_000_000, 320, 12_000
FRAMES = tuple(m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC))
CATEGORIES = ("card_images", "contracts", "templates")
SHAPE = rf"^(?:{'|'.join(CATEGORIES)})/[0-9]{{4}}/(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/[0-9a-f]{{8}}(?:-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}\.enc\z"

#: Segments of a JPG that are walked for its frame header.
SEGMENTS = 1024


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under path with their bytes; pruned to names before bytes are read if only those are asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def _u(x: Column, at: Column | int, n: int) -> Column:
    return F.conv(F.hex(F.substring(x, F.lit(at) if isinstance(at, int) else at, F.lit(n))), 16, 10).cast("long")


def image_kind(x: Column) -> Column:
    return F.when(F.hex(F.substring(x, 1, 3)) == "FFD8FF", "JPG").when(F.hex(F.substring(x, 1, 8)) == "89504E470D0A1A0A", "PNG")


def png_size(x: Column) -> Column:
    return F.when(image_kind(x) == "PNG", F.struct(_u(x, 17, 4).alias("width"), _u(x, 21, 4).alias("height")))


def jpg_size(x: Column) -> Column:
    """Width and height as the first frame header of a JPG says; null without one among its first SEGMENTS segments."""

    def step(at: Column, _: Column) -> Column:
        """The place of the next segment; a frame header's own place below 0; 0 where no segment can be read."""
        mark, size = _u(x, at + 1, 1), _u(x, at + 2, 2)
        here = at.cast("int")
        walk = F.when(mark == 0xFF, here + 1).when(mark.isin(*FRAMES), -here).when((mark == 1) | mark.between(0xD0, 0xD8), here + 2).when(~mark.isin(0xD9, 0xDA) & (size >= 2), here + 2 + size.cast("int"))
        return F.when(here <= 0, here).otherwise(F.coalesce(F.when(_u(x, here, 1) == 0xFF, walk), F.lit(0)))

    at = -F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), F.lit(3), step)
    size = lambda at: F.struct(_u(x, at + 7, 2).alias("width"), _u(x, at + 5, 2).alias("height"))
    return F.when(image_kind(x) == "JPG", _once(at, lambda at: F.when(at > 0, _once(size(at), lambda s: F.when((s["width"] > 0) & (s["height"] > 0), s)))))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x with x computed once, however often f reads it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def image_size(x: Column) -> Column:
    """Width and height as the file's header says; null if it says none."""
    return F.when(image_kind(x) == "PNG", png_size(x)).when(image_kind(x) == "JPG", jpg_size(x))


def probe(x: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Why an upload is refused, or null: empty, too large, of another kind, undecoded, too many pixels, edges out of bounds.

    Sizes that a decoder has found may be given; else those of the header count.
    """
    if width is None or height is None:
        return _once(image_size(x), lambda size: probe(x, size["width"], size["height"]))
    return (
        F.when(F.coalesce(F.octet_length(x), F.lit(0)) == 0, "EMPTY")
        .when(F.octet_length(x) > MAX_BYTES, "TOO_LARGE")
        .when(image_kind(x).isNull(), "UNSUPPORTED")
        .when(width.isNull() | height.isNull(), "UNDECODABLE")
        .when(width * height > MAX_PIXELS, "TOO_MANY_PIXELS")
        .when((F.least(width, height) < LEAST_EDGE) | (F.greatest(width, height) > MOST_EDGE), "BAD_SIZE")
    )


def new_content(files: DataFrame, stored: DataFrame, content: str = "content") -> DataFrame:
    """The first file of each digest that isn't stored yet; files are reduced to digests before any join."""
    hashed = files.withColumn("sha256", F.sha2(F.col(content), 256))
    first = hashed.groupBy("sha256").agg(F.min("path").alias("path"), F.count("*").alias("copies"))
    return first.join(stored.select("sha256"), "sha256", "left_anti")


def build_relative_path(category: Column, on: Column, file_id: Column) -> Column:
    return F.concat_ws("/", category, F.date_format(on, "yyyy"), F.date_format(on, "MM"), F.date_format(on, "dd"), F.concat(file_id, F.lit(".enc")))


def is_valid_shape(path: Column) -> Column:
    """A positive test, so parent steps, absolute paths, shares and streams fail it."""
    return F.coalesce(path.rlike(SHAPE), F.lit(False))


def resolves_within(path: Column, category: Column) -> Column:
    return is_valid_shape(path) & (F.substring_index(path, "/", 1) == category)


def save(blobs: DataFrame, path: str, key: bytes) -> DataFrame:
    """blobs (category, on, file_id, content, nonce) written encrypted by category and date; the committer makes it atomic."""
    aad = F.concat_ws("/", "category", "file_id")
    out = blobs.select("category", *[F.date_format("on", f).alias(n) for f, n in (("yyyy", "yyyy"), ("MM", "mm"), ("dd", "dd"))], "file_id", privacy.encrypt(F.col("content"), F.lit(key), F.col("nonce"), aad).alias("sealed"))
    out.write.mode("append").partitionBy("category", "yyyy", "mm", "dd").parquet(path)
    return blobs.select("file_id", build_relative_path(F.col("category"), F.col("on"), F.col("file_id")).alias("ref"))


def load(spark: SparkSession, path: str, key: bytes, refs: DataFrame | None = None) -> DataFrame:
    """file_id and content (null where authentication fails); refs (file_id) limits what is read."""
    stored = spark.read.parquet(path)
    if refs is not None:
        stored = stored.join(refs.select("file_id"), "file_id", "left_semi")
    return stored.select("file_id", privacy.decrypt(F.col("sealed"), F.lit(key), F.concat_ws("/", "category", "file_id")).alias("content"))


def present(refs: DataFrame, stored: DataFrame, key: str = "file_id") -> DataFrame:
    return refs.join(stored.select(key).distinct().withColumn("present", F.lit(True)), key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def orphans(files: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys that only the files or only the rows have."""
    a, b = files.select(key).distinct().withColumn("f", F.lit(True)), rows.select(key).distinct().withColumn("r", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.where("f is null or r is null").select(key, F.when(F.col("f").isNull(), "ROW_WITHOUT_FILE").otherwise("FILE_WITHOUT_ROW").alias("kind"))


def blobs(spark: SparkSession, path: str) -> versions.Store:
    """A store of encrypted blobs that can also be deleted."""
    return versions.Store(spark, path, ("ref",))


def keep(at: versions.Store, files: DataFrame, key: bytes, read_key: bytes | None = None) -> DataFrame:
    """files (category, on, file_id, content, nonce) committed as one version, once they have been reread and authenticated; their file_id and ref."""
    aad = F.concat_ws("/", "category", "file_id")
    ref = build_relative_path(F.col("category"), F.col("on"), F.col("file_id"))
    sealed = files.select(ref.alias("ref"), "category", "file_id", privacy.encrypt(F.col("content"), F.lit(key), F.col("nonce"), aad).alias("sealed"))
    opened = privacy.decrypt(F.col("sealed"), F.lit(read_key or key), aad)
    at.commit(at.snapshot(), sealed, check=lambda rows: rows.where(opened.isNull()))
    return files.select("file_id", ref.alias("ref"))


def open_all(at: versions.Store, key: bytes) -> DataFrame:
    """ref, file_id and content (null where authentication fails) of what is stored and not deleted."""
    return at.read().select("ref", "file_id", privacy.decrypt(F.col("sealed"), F.lit(key), F.concat_ws("/", "category", "file_id")).alias("content"))


def delete(at: versions.Store, refs: DataFrame) -> None:
    """Deletes blobs by ref, those that aren't there too; nothing, and an error, if a ref isn't one that the store makes."""
    if not refs.where(~is_valid_shape(F.col("ref"))).isEmpty():
        raise ValueError("refs of another shape")
    at.delete(refs)
