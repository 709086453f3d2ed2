"""Operators on small frames."""

import datetime
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import decode
from tessera.operators import fusion, lifecycle, normalize, rules, spatial, spec, templates
from tessera.plans.records import ALIASES
from tessera.sources import vault


def candidates(spark, rows):
    return spark.createDataFrame([("e", *r, i) for i, r in enumerate(rows)], "entity string, field_key string, source string, value string, confidence double, arrival int")


def fused(spark, rows):
    return {r.field_key: r for r in fusion.fuse(candidates(spark, rows)).collect()}


def test_fusion_first_best_and_votes(spark):
    r = fused(spark, [("full_name", "OCR", "A", 0.7), ("full_name", "MANUAL", "B", 0.5), ("full_name", "QR", "A", 0.6)])
    assert len(r) == 6
    assert (r["full_name"].value, r["full_name"].source, r["full_name"].agreement) == ("A", "QR", True)
    assert abs(r["full_name"].confidence - 0.7) < 1e-9


def test_fusion_conflict_and_blank(spark):
    r = fused(spark, [("issue_date", "QR", "1", 0.95), ("issue_date", "MRZ", "2", 0.99), ("expiry_date", "QR", "", 1.0)])
    assert (r["issue_date"].value, r["issue_date"].confidence, r["issue_date"].flags) == ("1", 0.5, ["SOURCE_CONFLICT"])
    assert r["expiry_date"].value is None


def test_fusion_id_rules(spark):
    r = fused(spark, [("id_number", "QR", "001199012345", 0.9), ("id_number", "MRZ", "001199012346", 0.5), ("date_of_birth", "QR", "1998-01-01", 0.9)])
    assert r["id_number"].flags == ["CARD_MISMATCH", "ID_INCONSISTENT"] and r["id_number"].needs_review


def test_overall(spark):
    r = fusion.overall(fusion.fuse(candidates(spark, [("id_number", "QR", "001199012345", 1.0)]))).first()
    assert r.overall == 0.3 and r.needs_retake


def test_rule_sets():
    assert len(rules.rules_in("ocr")) == 23 and rules.rules_in("form") == ()


def test_normalize_fields(spark):
    rows = [("id_number", "OO1199O12345", 2.0), ("full_name", "h0ang  van", 0.5), ("expiry_date", "KHONG THOI HAN", 0.9), ("issue_date", "71/01/1990", 0.9), ("issue_date", " ", 0.9)]
    got = normalize.fields(spark.createDataFrame(rows, "field_key string, text string, confidence double")).collect()
    assert [(r.value, r.confidence, r.flags) for r in got] == [("001199012345", 1.0, []), ("HOANG VAN", 0.5, []), ("KHÔNG THỜI HẠN", 0.9, ["NO_EXPIRY"]), ("1990-01-11", 0.75, ["DATE_REPAIRED"]), (None, 0.0, ["UNPARSEABLE"])]


def test_issue_place_tiers(spark):
    aliases = spark.createDataFrame(ALIASES, "ord int, alias_normalized string, keywords array<string>, canonical_value string, assigned_confidence double")
    rows = spark.createDataFrame([("bộ công an", 1.0), ("cuc truong cuc canh sat", 1.0), ("Bo Cong", 1.0), ("zz quan ly hanh", 1.0), ("???", 1.0), (None, 1.0)], "text string, confidence double")
    got = {r.text: (r.tier, r.confidence) for r in normalize.issue_places(rows, aliases).collect()}
    assert got["bộ công an"] == (1, 1.0) and got["cuc truong cuc canh sat"] == (2, 0.95) and got["Bo Cong"][0] == 5
    assert got["zz quan ly hanh"][0] == 4 and got["???"] == (None, 0.0) and got[None] == (None, 0.0)


def test_reading_order(spark):
    r = spark.createDataFrame([(1, 0, 0.5, 0.10, 0.1), (1, 1, 0.1, 0.12, 0.1), (1, 2, 0.0, 0.40, 0.1)], "image long, ord int, x double, y double, h double")
    assert [x.ord for x in spatial.sort_reading_order(r).orderBy("place").collect()] == [1, 0, 2]
    # Centres tell lines, not tops: a tall region shares its line with a short one beside its middle.
    r = spark.createDataFrame([(1, 0, 0.5, 0.10, 0.20), (1, 1, 0.1, 0.19, 0.02), (1, 2, 0.0, 0.40, 0.1), (1, 3, 0.2, 0.47, 0.1)], "image long, ord int, x double, y double, h double")
    assert [(x.ord, x.line) for x in spatial.sort_reading_order(r).orderBy("place").collect()] == [(1, 0), (0, 0), (2, 1), (3, 2)]


def test_beside_label(spark):
    rows = [(1, 0, "Tên", 0.9, 0.1, 0.1, 0.1, 0.05, []), (1, 1, "AN", 0.8, 0.4, 0.11, 0.1, 0.05, ["n"]), (1, 2, "BINH", 0.9, 0.1, 0.18, 0.1, 0.05, ["n"])]
    regions = spark.createDataFrame(rows, "image long, ord int, text string, confidence double, x double, y double, w double, h double, fits array<string>")
    labels = spark.createDataFrame([(1, 0, "n")], "image long, ord int, field_key string")
    assert spatial.beside_label(regions, labels).first().text == "AN"
    left = [rows[0], (1, 1, "LEFT", 0.8, 0.0, 0.11, 0.1, 0.05, ["n"]), (1, 2, "BELOW", 0.9, 0.1, 0.18, 0.1, 0.05, ["n"])]
    assert spatial.beside_label(spark.createDataFrame(left, regions.schema), labels).first().text == "BELOW"
    # A label that no value comes after leaves the field to the next one.
    two = [rows[0], (1, 1, "Tên", 0.9, 0.1, 0.6, 0.1, 0.05, []), (1, 2, "AN", 0.9, 0.3, 0.6, 0.1, 0.05, ["n"])]
    both = spark.createDataFrame([(1, 0, "n"), (1, 1, "n")], labels.schema)
    assert spatial.beside_label(spark.createDataFrame(two, regions.schema), both).first().text == "AN"


def test_charsets():
    assert spatial.parse_charset("Z-A") == frozenset("Z-A") and spatial.parse_charset("A-C-E") == frozenset("ABC-E")
    assert len(spatial.parse_charset("A-Z0-9<")) == 37 and spatial.parse_charset("-a") == frozenset("-a") and spatial.parse_charset("") == frozenset()


def test_bands_and_votes(spark):
    """Gaps of 0.04 to 0.12 that differ by 0.025 at most, heights by 0.02; only a lone block near an edge decides."""
    make = lambda image, centres, h=0.03: [(image, c, h) for c in centres]
    rows = make(1, [0.80, 0.86, 0.92]) + make(2, [0.10, 0.16, 0.22]) + make(3, [0.1, 0.16, 0.22, 0.8, 0.86, 0.92]) + make(4, [0.45, 0.50, 0.55]) + make(5, [0.1, 0.3, 0.5]) + [(6, 0.1, 0.03), (6, 0.16, 0.06), (6, 0.22, 0.03)] + make(7, [0.1, 0.15, 0.23]) + make(8, [0.4, 0.46, 0.52, 0.8, 0.86, 0.92])
    found = spatial.evenly_spaced_bands(spark.createDataFrame(rows, "image int, centre double, h double"))
    assert sorted((r.image, round(r.centre, 2)) for r in found.collect()) == [(1, 0.86), (2, 0.16), (3, 0.16), (3, 0.86), (4, 0.5), (8, 0.46), (8, 0.86)]
    assert {r.image: r.upside_down for r in spatial.orientation_vote(found).collect()} == {1: False, 2: True, 3: None, 4: None, 8: False}


def test_repairs_are_the_first_in_order():
    """Against trying edits depth first."""
    rng = random.Random(1)

    def plain(chars, start, left, digit):
        if decode._digit_of(chars) == digit:
            return chars
        tries = ((i, o) for i in range(start, len(chars)) for o in decode.ALTERNATIVES.get(chars[i], "")) if left else ()
        return next((found for i, o in tries if (found := plain(chars[:i] + o + chars[i + 1 :], i + 1, left - 1, digit))), None)

    for _ in range(40):
        value, digit = "".join(rng.choice("0123456789<A") for _ in range(rng.choice([6, 9, 14]))), rng.choice("0123456789<")
        assert decode.repair_group(value, digit) == plain(value, 0, decode.MAX_EDITS, digit)


def test_spec_paging_and_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", None), (3, "b", datetime.datetime(2024, 1, 1))], "id int, v string, deleted_at timestamp")
    p = spec.page(df, spec.Specification(order_by=("-v",), page_size=1)).collect()
    assert [(r.id, r.total, r.has_next) for r in p] == [(1, 2, True)]


def test_transitions(spark):
    h = spark.createDataFrame([("a", 1, "DRAFT"), ("a", 2, "COMPLETED"), ("a", 3, "VOIDED")], "k string, t int, status string")
    assert [(r.was, r.status) for r in lifecycle.illegal_transitions(h, "k", lifecycle.CONTRACT, "t").collect()] == [("DRAFT", "COMPLETED")]


def test_blacklist_and_markers(spark):
    src = "openxmlformats import\n{{ x['MRO'] }} {{r a.b }}{{ r }}\n{{p photo }} {%p if x %}"
    c = F.lit(src)
    r = spark.range(1).select(templates.blacklist_hits(c).alias("b"), templates.richtext_variables(c).alias("r"), templates.image_paragraphs(c).alias("i"), templates.plain_tags(c).alias("p")).first()
    assert (r.b, r.r, r.i) == (["từ khoá 'mro'"], ["a.b"], [2]) and "{{ photo }} {% if x %}" in r.p and "{{ a.b }}{{ r }}" in r.p


def test_vault_round_trip(spark, tmp_path):
    rows = [("contracts", datetime.date(2024, 5, 1), "f1", b"hello", b"n" * 12)]
    blobs = spark.createDataFrame(rows, "category string, on date, file_id string, content binary, nonce binary")
    vault.save(blobs, str(tmp_path / "v"), b"k" * 32)
    assert bytes(vault.load(spark, str(tmp_path / "v"), b"k" * 32).first().content) == b"hello"
    assert vault.load(spark, str(tmp_path / "v"), b"x" * 32).first().content is None


def test_path_guard(spark):
    good = "contracts/2024/05/01/01234567-89ab-cdef-0123-456789abcdef.enc"
    bad = ["../" + good, "/" + good, good.replace("contracts", "other"), good + ":x", good.replace("/05/", "/13/")]
    got = spark.createDataFrame([(p,) for p in [good, *bad]], "p string").select(vault.is_valid_shape(F.col("p")).alias("v")).collect()
    assert [r.v for r in got] == [True] + [False] * len(bad)


def test_streaming_queue(spark, tmp_path):
    from tessera.streaming import queue

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "QUEUED"), (2, "DONE")], "id int, status string").write.parquet(src)
    q = queue.run(spark.readStream.schema("id int, status string").parquet(src), lambda df: df.withColumn("status", F.lit("SUCCEEDED")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_regions(spark):
    rows = [(1, 200, 100, [([10.0, 60.0, -5.0], [20.0, 30.0, 120.0], " te\u0302n ", 0.9), ([], [], "x", 0.9), ([1.0], [1.0], "  ", 0.5), ([1.0], [1.0], None, 0.5)]), (2, 10, 10, None)]
    pages = spark.createDataFrame(rows, "image int, width int, height int, items array<struct<xs array<double>, ys array<double>, text string, score double>>".replace("xs array", "xs: array").replace("ys array", "ys: array").replace("text string", "text: string").replace("score double", "score: double"))
    got = spatial.to_regions(pages).collect()
    assert [(r.image, r.ord, r.text, r.confidence) for r in got] == [(1, 0, "t\u00ean", 0.9)]
    assert (got[0].x, got[0].y, got[0].w, got[0].h) == (0.0, 0.2, 0.3, 0.8)


def test_first_valid_block(spark):
    rows = [(1, 3, False, "a"), (1, 4, True, "b"), (2, 3, False, "c"), (2, 4, False, "d"), (3, 3, True, "e"), (3, 4, True, "f")]
    got = decode.first_valid(spark.createDataFrame(rows, "image int, variant int, checksum_valid boolean, birth string"), "image", "variant", ["birth", "checksum_valid"]).collect()
    assert {(r.image, r.birth, r.checksum_valid) for r in got} == {(1, "b", True), (2, "c", False), (3, "e", True)}


def test_inserts_and_conflicts_part_the_new_rows(spark):
    new, stored = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int"), spark.createDataFrame([(3,), (3,)], "k int")
    assert sorted(r.k for r in spec.conflicts(new, stored, ["k"]).collect()) == [2, 2, 3]
    assert [r.k for r in spec.insertable(new, stored, ["k"]).collect()] == [1]


def test_probe_reads_sizes_from_headers(spark):
    frame = lambda w, h, mark=0xC0: struct.pack(">BBHBHH", 0xFF, mark, 11, 8, h, w) + b"\1\0\0\0"
    segment = lambda mark, n: struct.pack(">BBH", 0xFF, mark, n + 2) + b"\xff\xc0" * (n // 2)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 700, 400)
    files = {
        "plain": b"\xff\xd8" + segment(0xE0, 14) + frame(640, 480),
        "large segments, tables, fill bytes": b"\xff\xd8" + segment(0xE1, 60000) + segment(0xC4, 20) + b"\xff\xff" + frame(1000, 500, 0xC2),
        "small": b"\xff\xd8" + segment(0xE0, 14) + frame(100, 480),
        "scan first": b"\xff\xd8" + segment(0xDA, 8) + frame(640, 480),
        "cut": (b"\xff\xd8" + segment(0xE0, 14) + frame(640, 480))[:24],
        "no height": b"\xff\xd8" + frame(640, 0),
        "png": png,
        "text": b"hello",
        "empty": b"",
    }
    rows = spark.createDataFrame([*files.items(), ("null", None)], "name string, content binary")
    got = {r.name: (r.size and tuple(r.size), r.why) for r in rows.select("name", vault.image_size(F.col("content")).alias("size"), vault.probe(F.col("content")).alias("why")).collect()}
    assert got == {
        "plain": ((640, 480), None), "large segments, tables, fill bytes": ((1000, 500), None), "small": ((100, 480), "BAD_SIZE"), "scan first": (None, "UNDECODABLE"), "cut": (None, "UNDECODABLE"),
        "no height": (None, "UNDECODABLE"), "png": ((700, 400), None), "text": (None, "UNSUPPORTED"), "empty": (None, "EMPTY"), "null": (None, "EMPTY"),
    }


def test_error_code(spark):
    rows = spark.createDataFrame([(1, "A", ["x"]), (2, "odd", ["mine", "storage", "base"]), (3, None, ["base"]), (4, "odd", None), (5, "odd", ["crypto", "storage"])], "id int, code string, types array<string>")
    answer = lifecycle.error_code(F.col("code"), F.col("types"), ["A", "S", "B"], [("crypto", "not known"), ("storage", "S"), ("base", "B")], "E")
    assert [r.c for r in rows.orderBy("id").select(answer.alias("c")).collect()] == ["A", "S", "B", "E", "S"]


def test_contexts_are_checked_when_planned(spark):
    good = spark.range(1).select(F.lit("a").alias("t"), F.struct(F.array(F.lit(1)).alias("n"), F.create_map(F.lit("k"), F.lit(0.5)).alias("m")).alias("s"))
    assert templates.assert_render_safe(good) is good
    bad = good.select("s", F.current_date().alias("day"), F.create_map(F.lit(1), F.array(F.lit(b"x"))).alias("m"))
    assert templates.unsafe_paths(bad.schema) == ["day", "m{key}", "m{}[]"]
    with pytest.raises(TypeError, match="day"):
        templates.assert_render_safe(bad)


def test_repairs_in_columns(spark):
    """Against the plain version, whole lines too."""
    rng = random.Random(2)
    made = [("".join(rng.choice("0123456789<A") for _ in range(rng.choice([1, 6, 9, 14]))), rng.choice("0123456789<")) for _ in range(150)] + [("", "3"), ("", "0"), (None, "1"), ("123456", None)]
    rows = spark.createDataFrame(made, "v string, d string").coalesce(2)
    for r in rows.select("v", "d", decode.repaired_group(F.col("v"), F.col("d")).alias("got")).collect():
        assert r.got == (None if r.v is None or r.d is None else decode.repair_group(r.v, r.d)), r
    lines = ["".join(rng.choice("0123456789") for _ in range(30)) for _ in range(60)]
    for r in spark.createDataFrame([(x,) for x in lines], "x string").coalesce(2).select("x", decode.repaired_line(F.col("x"), decode.GROUPS[0]).alias("got")).collect():
        want = r.x
        for a, b, at in decode.GROUPS[0]:
            if decode._digit_of(want[a:b]) != want[at]:
                want = want[:a] + (decode.repair_group(want[a:b], want[at]) or want[a:b]) + want[b:]
        assert r.got == want
