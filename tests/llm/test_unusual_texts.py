"""Texts that hashes, tokens and character classes have to be right about: typographic variants, clashing words, letters of any script."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, near_dedup, pii
from tessera.llm.common import word_hashes

SCHEMA = "doc_id long, text string"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def clashing(n):
    """Two words of 2**n letters that every polynomial modulo 2**64 takes for one another once n is large."""
    one = "a"
    for _ in range(n):
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


ITEM = "the quick brown fox jumps over lazy dogs every single day"
VARIANTS = [
    ITEM, "the “quick” brown fox jumps over “lazy” dogs — “every” single day", "THE QUICK—BROWN FOX JUMPS over «lazy» dogs… every single day!", "the quick brown fox、jumps over lazy dogs。every　single day",
    "the ‘quick’ brown fox, jumps over lazy-dogs every_single day", "ｔｈｅ quick brown fox jumps over lazy dogs every single day",
]


@pytest.mark.parametrize("item", VARIANTS)
def test_typographic_variants_are_found(spark, item):
    benchmark = spark.createDataFrame([(1, item), (2, "été à la plage avec des œufs bien frais")], "item_id long, text string")
    rows = decontamination.measure(docs_of(spark, [*VARIANTS, "Été « à la plage » avec des œufs — bien frais.", "été a la plage", None, ""]), benchmark).orderBy("doc_id").collect()
    assert [(r.item_id, r.coverage) for r in rows[:7]] == [(1, 1.0)] * 6 + [(2, 1.0)]
    assert not any(r.contaminated for r in rows[7:])


@pytest.mark.parametrize("n", [7, 10, 12])
def test_clashing_words_are_told_apart(spark, n):
    one, other = clashing(n)
    assert len({*word_hashes(f"{one} {other} {one.upper()}").tolist()}) == 2
    texts = [" ".join([one, "x", one, "y", one]), " ".join([other, "x", other, "y", other])]
    rows = near_dedup.near_duplicates(docs_of(spark, texts), 2).collect()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 1}
    benchmark = spark.createDataFrame([(1, texts[0])], "item_id long, text string")
    assert [r.contaminated for r in decontamination.measure(docs_of(spark, texts), benchmark).orderBy("doc_id").collect()] == [True, False]


def test_equal_sets_of_other_words_are_confirmed(spark):
    """Rows of one set of shingles in another order and number are linked, as are those of the same words in other case and space."""
    texts = ["a b a b a c", "a b a c", "A  b\ta B a c", "a b a b a c", "c a b a"]
    rows = near_dedup.near_duplicates(docs_of(spark, texts), 2).collect()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


NAMES = ["Dr. Արամ Հակոբյան", "Prof. Łęż", "Dr. Ðđ Þþ", "Dr. Nguyễn Ắnh", "Dr. Šárka Žďárská", "Prof. Ñandú Æsir", "Dr. Ёлкин Йорк", "Prof. Ώρα Ϊων"]


def test_no_word_of_a_name_stays(spark):
    found = pii.entities(docs_of(spark, [f"spoke to {n} there" for n in NAMES]), "k")
    rows = found.collect()
    assert len(rows) == len(NAMES)
    for r in rows:
        assert all(a != b for a, b in zip(r.entity.split()[1:], r.surrogate.split()[1:], strict=True)), (r.entity, r.surrogate)
        assert [c.isupper() for c in r.entity.split(" ", 1)[1]] == [c.isupper() for c in r.surrogate.split(" ", 1)[1]]
    assert pii.collisions(docs_of(spark, [f"spoke to {n} there" for n in NAMES]), "k").count() == 0


def test_surrogates_of_unlisted_letters_are_distinct(spark):
    low, capitals = "łężđðþæœøßñşğıå", "ŁĘŻĐÐÞÆŒØÑŞĞÅ"
    names = [f"Dr. {a}{b}{c}" for a in capitals for b in low if b != "ß" and b != "ı" for c in "łęża"]
    rows = pii.entities(docs_of(spark, names), "k").select("entity", "surrogate").distinct().collect()
    assert len(rows) == len(names) == len({r.surrogate for r in rows})
    assert not pii.collisions(docs_of(spark, names), "k").where(F.col("n") > 1).count()
