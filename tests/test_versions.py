"""The versioned store: refused writers, deletes, upserts, time travel, compaction and what is left after it."""

import datetime

import pytest

from tessera.sources import vault
from tessera.sources.versions import Conflict, Duplicate, Store, Unsound


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def seen(df):
    return sorted((r.k, r.v) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s", ("k",))


def test_of_two_writers_one_is_refused(spark, store):
    one = store.snapshot()
    store.commit(one, rows(spark, (1, "a")))
    with pytest.raises(Conflict):
        store.commit(one, rows(spark, (1, "b")))
    assert seen(store.read()) == [(1, "a")] and store.versions() == [1]
    assert len(store._names("parts")) == 1 and store._names("log") == ["0" * 19 + "1.json"]


def test_a_change_is_computed_anew_after_a_conflict(spark, store):
    store.insert(rows(spark, (1, "a")))
    met = []

    def change(stored):
        met.append(seen(stored))
        if len(met) == 1:
            store.upsert(rows(spark, (2, "other")))
        return rows(spark, (3, str(stored.count()))), None

    store.transact(change)
    assert met == [[(1, "a")], [(1, "a"), (2, "other")]] and (3, "2") in seen(store.read())
    with pytest.raises(Conflict):
        store.transact(lambda _: (store.delete(rows(spark, (9, ""))) and rows(spark, (4, "")), None), tries=1)


def test_deletes_upserts_and_older_versions(spark, store):
    assert store.read() is None and not store.present(rows(spark, (1, ""))).first().present
    store.insert(rows(spark, (1, "a"), (2, "b"), (3, "c")))
    store.delete(rows(spark, (2, ""), (2, ""), (7, "")))
    store.upsert(rows(spark, (2, "again"), (3, "new")))
    assert seen(store.read()) == [(1, "a"), (2, "again"), (3, "new")]
    assert seen(store.read(1)) == [(1, "a"), (2, "b"), (3, "c")] and seen(store.read(2)) == [(1, "a"), (3, "c")]
    assert {r.k: r.present for r in store.present(rows(spark, (1, ""), (7, ""))).collect()} == {1: True, 7: False}
    with pytest.raises(LookupError):
        store.read(9)


def test_duplicates_are_refused_whole(spark, store):
    store.insert(rows(spark, (1, "a")))
    for bad in ([(1, "b"), (2, "c")], [(4, "x"), (4, "y")], [(None, "n")]):
        with pytest.raises(Duplicate):
            store.insert(rows(spark, *bad))
    assert seen(store.read()) == [(1, "a")] and store.versions() == [1]


def test_null_keys_and_extra_columns(spark, store):
    store.upsert(rows(spark, (None, "a"), (1, "b")))
    store.upsert(spark.createDataFrame([(None, "c", 5)], "k long, v string, extra int"))
    assert sorted(store.read().collect(), key=str) == [(1, "b", None), (None, "c", 5)]
    with pytest.raises(ValueError):
        store.upsert(rows(spark, (1, "b")).withColumnRenamed("v", "committed_at"))
    store.upsert(rows(spark).limit(0))
    assert store.read().count() == 2


def test_what_is_deleted_is_gone_after_compaction(spark, store, tmp_path):
    store.insert(rows(spark, (1, "kept"), (2, "secret")))
    store.delete(rows(spark, (2, "")))
    waiting = store._write(rows(spark, (5, "late")), "parts", 4)  # of a writer that hasn't committed yet
    store.compact()
    gone = store.vacuum()
    assert len(gone) == 2 and store.versions() == [3] and seen(store.read()) == [(1, "kept")]
    assert store._names("gone") == [] and waiting.split("/")[1] in store._names("parts")
    assert seen(spark.read.option("recursiveFileLookup", "true").parquet(f"{store.path}/parts").where("committed_at < 4")) == [(1, "kept")]
    with pytest.raises(LookupError):
        store.read(1)


def test_unsound_parts_are_not_committed(spark, store):
    with pytest.raises(Unsound):
        store.commit(store.snapshot(), rows(spark, (1, "a"), (2, None)), check=lambda r: r.where("v is null"))
    assert store.versions() == [] and store._names("parts") == []


def test_vault_deletes(spark, tmp_path):
    key, day, ids = b"k" * 32, datetime.date(2024, 5, 1), [f"0123456{n}-89ab-cdef-0123-456789abcdef" for n in (1, 2)]
    blobs = spark.createDataFrame([("contracts", day, i, i.encode(), b"n" * 12) for i in ids], "category string, on date, file_id string, content binary, nonce binary")
    at = vault.blobs(spark, f"file://{tmp_path}/v")
    refs = vault.keep(at, blobs, key)
    assert sorted(bytes(r.content).decode() for r in vault.open_all(at, key).collect()) == ids
    one = refs.where(f"file_id = '{ids[0]}'")
    for _ in range(2):  # deleting again does nothing
        vault.delete(at, one)
    assert [r.file_id for r in vault.open_all(at, key).collect()] == ids[1:]
    with pytest.raises(ValueError):
        vault.delete(at, spark.createDataFrame([("../x", ids[1])], "ref string, file_id string"))
    with pytest.raises(Unsound):
        vault.keep(at, blobs.limit(1).selectExpr("category", "on", "'z' as file_id", "content", "nonce"), key, b"x" * 32)
