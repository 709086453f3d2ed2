"""Render contexts and the inspection of templates' variables, tags and vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType

# Words that no tag may hold, in any letter case, and what a hit is called.
BLACKLIST = ("__", "mro", "subclasses", "globals", "builtins", "import", "eval", "exec", "popen", "os.", "sys.", "lipsum", "cycler", "namespace")
HIT = "từ khoá '{}'"
SAFE = (StringType, BooleanType, IntegralType, FloatType, DoubleType, NullType)


def build(*layers: Column) -> Column:
    """Maps laid over one another, later ones on top (needs spark.sql.mapKeyDedupPolicy=LAST_WIN, or see layered())."""
    return F.map_concat(*layers)


def layered(*layers: Column) -> Column:
    """As build(), under any policy: keys of later layers are taken out of earlier ones first."""

    def over(below: Column, layer: Column) -> Column:
        return F.map_concat(F.map_filter(below, lambda k, _: ~F.array_contains(F.map_keys(layer), k)), layer)

    return reduce(over, layers)


def suppressed(context: Column, keys: Column) -> Column:
    """The context with the suppressed keys blank."""
    return F.transform_values(context, lambda k, v: F.when(F.array_contains(keys, k), "").otherwise(v))


def or_else(x: Column, other: Column) -> Column:
    """x unless it is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), other)


def missing_required(required: Column, hidden: Column, context: Column) -> Column:
    return F.filter(F.array_except(required, hidden), lambda k: F.trim(F.coalesce(F.element_at(context, k), F.lit(""))) == "")


def declared_extras(declared: Column, values: Column) -> Column:
    """Only declared keys are given out."""
    return F.map_filter(values, lambda k, _: F.array_contains(declared, k))


def fill(template: Column, context: Column) -> Column:
    """{{ key }} tokens of a text filled from a map, unknown ones with nothing."""
    token = r"\{\{\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\}\}"
    pieces, keys = F.split(template, token, -1), F.regexp_extract_all(template, F.lit(token), F.lit(1))
    values = F.transform(keys, lambda k: F.coalesce(F.element_at(context, k), F.lit("")))
    return F.array_join(F.zip_with(pieces, values, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")


def tags(source: Column) -> Column:
    return F.regexp_extract_all(source, F.lit(r"(?s)(\{\{.*?\}\}|\{%.*?%\})"), F.lit(1))


def blacklist_hits(source: Column) -> Column:
    """Forbidden words inside tags only: around them the format itself has some."""
    inside = F.lower(F.array_join(tags(source), " "))
    hits = F.filter(F.array(*map(F.lit, BLACKLIST)), lambda w: F.contains(inside, w))
    before, after = HIT.split("{}")
    return F.transform(hits, lambda w: F.concat(F.lit(before), w, F.lit(after)))


def richtext_variables(source: Column) -> Column:
    """Paths written so that their style is kept."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(source, F.lit(r"\{\{r\s+([A-Za-z_](?U:[\w.])*)"), F.lit(1))))


def image_paragraphs(source: Column) -> Column:
    """Paragraphs, from 0, with a placeholder for an image."""
    at = F.transform(F.split(source, "\n"), lambda line, i: F.when(line.rlike(r"(?U)\{\{p\s|\{%p\s"), i))
    return F.filter(at, lambda i: i.isNotNull())


def plain_tags(source: Column) -> Column:
    """Tags without the prefixes that say what of a document they replace: those are no part of the grammar."""
    return F.regexp_replace(source, r"(?U)(\{[{%])(?:r|p|tr|tc)\s", "$1 ")


def unsafe_paths(context: DataType, at: str = "") -> list[str]:
    """Paths in a context's schema whose type no template may see: only plain values and containers of them are safe."""
    if isinstance(context, StructType):
        return [p for f in context.fields for p in unsafe_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(context, ArrayType):
        return unsafe_paths(context.elementType, f"{at}[]")
    if isinstance(context, MapType):
        keys = [] if isinstance(context.keyType, StringType) else [f"{at}{{key}}"]
        return keys + unsafe_paths(context.valueType, f"{at}{{}}")
    return [] if isinstance(context, SAFE) else [at]


def assert_render_safe(contexts: DataFrame) -> DataFrame:
    """contexts, if every column is safe to render; an error when the plan is made otherwise."""
    if found := unsafe_paths(contexts.schema):
        raise TypeError(f"not safe to render: {', '.join(found)}")
    return contexts
