"""The pipeline's stages against plain versions, and the registered queries on the smallest tables."""

import hashlib
import math
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import mixing, queries
from tessera.llm.decontamination import Block, tokens
from tessera.llm.near_dedup import shingle_set

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the supplied tables")


def test_stages(spark):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas().set_index("doc_id")["text"] if "text" in docs.columns else None
        out = stage(spark, docs, str(DATA)).cache()
        kept = set(out.toPandas()["doc_id"])
        seen.append(name)
        if name != "mixing":
            assert out.columns == columns
        if name == "near_dedup":
            sets = {i: shingle_set(t, 5) for i, t in before.items()}
            alike = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
            assert all(any(j < i and alike(sets[i], sets[j]) for j in sets) for i in sets if i not in kept)
            left = sorted(kept)
            assert not any(alike(sets[a], sets[b]) for k, a in enumerate(left) for b in left[:k])
        if name == "decontamination":
            items = [(r.item_id, tokens(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            block = Block(items)
            assert kept == {i for i, t in before.items() if all(c < 0.8 for _, c in block.coverages(t))}
        if name in ("pii", "mixing"):
            assert kept == set(before.index)
        docs = out
    assert seen == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]


def plain_tiling(text, item, least=5):
    free_text, free_item = [True] * len(text), [True] * len(item)
    for size in range(len(item), least - 1, -1):
        for j in range(len(text) - size + 1):
            for i in range(len(item) - size + 1):
                if all(free_text[j : j + size]) and all(free_item[i : i + size]) and text[j : j + size] == item[i : i + size]:
                    free_text[j : j + size] = free_item[i : i + size] = [False] * size
                    break
    return 1 - sum(free_item) / len(item)


def plain_mix(docs):
    """Words taken of (doc_id, source, size) rows, by walking each source's documents in the order of their digests."""
    total = Counter()
    for _, source, size in docs:
        total[source] += size
    taken = Counter()
    for source, whole, target, _ in mixing.targets(list(total.items())):
        left, turn = math.floor(target + 0.5), 0
        while left > 0 and whole:
            for i, _, size in sorted((d for d in docs if d[1] == source), key=lambda d: hashlib.md5(f"{'' if d[0] is None else d[0]}:{turn}".encode()).hexdigest()):  # noqa: B023
                taken[i] += min(size, left)
                left -= min(size, left)
            turn += 1
    return {i: (size, taken[i]) for i, _, size in docs}


def test_run_against_a_plain_pipeline(spark, tmp_path):
    """All stages over a table with nulls, repeats, copies, an item, toxic texts and columns of clashing names."""
    rng = random.Random(21)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    texts = [say(rng.randrange(8, 40)) for _ in range(40)]
    texts = [f"{t} you idiot" if i % 4 == 0 else t for i, t in enumerate(texts)]
    item = say(20)
    texts += [texts[1], texts[2] + " x y", f"{' '.join(item.split()[10:])} and {' '.join(item.split()[:10])}", item[:60], None, "", "  ", None, "mail bob@site.example.com now or call 386-555-3733"]
    rows = [(i, t, "en", [None, "a", "b"][i % 3], 0 if t is None else len(t), "k", "s") for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[5], "en", "a", 3, "k", "s"), (None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __gone_id string, tid string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.size, r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.doc_id is not None}
    left = [r for r in rows if r[0] is not None and "idiot" not in (r[1] or "")]
    left = sorted({r[:2]: r for r in left}.values(), key=lambda r: r[0])
    sets = {r[0]: shingle_set(r[1], 5) for r in left}
    alike = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    left = [r for k, r in enumerate(left) if not any(alike(sets[r[0]], sets[o[0]]) for o in left[:k])]
    left = [r for r in left if plain_tiling((r[1] or "").split(), item.split()) < 0.8]
    size = lambda t: len((t or "").split())
    null_rows = [r for r in rows if r[0] is None]
    want = plain_mix([(r[0], r[3], size(r[1])) for r in left + null_rows])
    assert got == {i: v for i, v in want.items() if i is not None}
    docs = corpus_pipeline.replace_personal_data(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert docs.columns == [c.split()[0] for c in schema.split(", ")] and not any("bob@" in (r.text or "") or r.n_chars != (None if r.text is None else len(r.text)) for r in docs.collect())


def test_stages_on_empty_tables(spark, tmp_path):
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long, x int", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "mixing" or out.columns == docs.columns)


#: By their contracts these give no row a document: neighbours of queries, and pairs and terms of sources.
OTHERS = {"op12_neighbours", "op13_divergence"}


@pytest.mark.parametrize("name", sorted(queries.queries().keys() - OTHERS))
def test_query_covers_all_rows(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = queries.queries()[name](spark, str(DATA))
    assert out.select("doc_id").distinct().count() == out.count() == docs.count()


def test_neighbours_of_every_query(spark):
    """The whole table is asked and searched: each query has twenty ranks, or as many as there are other rows."""
    ids = {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    rows = queries.queries()["op12_neighbours"](spark, str(DATA)).collect()
    ranks = {}
    for r in rows:
        ranks.setdefault(r.query_id, []).append(r["rank"])
    assert ranks.keys() == {i for i in ids if i % 20 == 0}
    assert all(sorted(x) == list(range(1, min(20, len(ids) - 1) + 1)) for x in ranks.values())


@pytest.mark.parametrize("name", ["op11_manifest", "op13_divergence"])
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(columns)
    found = [tuple(r) for r in got.select(*columns).collect()]
    assert found and Counter(found) == Counter(want.fetchall())
