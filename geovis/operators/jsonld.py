"""JSON-LD blocks of a page as variants, flattened and summarised within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geovis.functions import html as H
from geovis.functions.core import unfold, whole_json
from geovis.functions.text import js_trim

_SCRIPT = r"(?is)(<script\b[^>]*>.*?(?:</script\s*>|\z))"
_TYPE = r"""(?i)<script\b[^>]*\stype\s*=\s*["']?application/ld\+json["']?[\s>/]"""

# Type groups the checks ask for.
ORGANIZATION = ["Organization"]
LOCAL_BUSINESS = [
    "LocalBusiness", "Hotel", "Restaurant", "Store", "BedAndBreakfast", "Resort",
    "TouristAttraction", "LodgingBusiness",
]
BRAND_OWNERS = ["Organization", "Hotel", "LocalBusiness", "Restaurant", "Resort", "LodgingBusiness"]
OFFERINGS = ["Product", "Service", "Offer"]
QUESTION_PAGES = ["FAQPage", "QAPage"]
REVIEWS = ["Review", "AggregateRating"]
BREADCRUMBS = ["BreadcrumbList"]
ARTICLES = ["Article", "BlogPosting", "NewsArticle"]


# A stated count above this is taken as this, so that no cast and no sum of a page overflows.
MOST_REVIEWS = 1e15


def raw_blocks(plain: Column) -> Column:
    """Texts of the JSON-LD scripts of a page without comments, blank ones dropped."""
    scripts = F.filter(
        F.regexp_extract_all(plain, F.lit(_SCRIPT), 1), lambda s: s.rlike(_TYPE)
    )
    bodies = F.transform(
        scripts, lambda s: F.regexp_replace(s, r"(?is)\A<script\b[^>]*>|</script\s*>\z", "")
    )
    return F.filter(bodies, lambda b: js_trim(b) != "")


def parsed(blocks: Column) -> Column:
    """array(variant); null marks a block that is no valid JSON."""
    return F.transform(blocks, whole_json)


def _at(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def objects(values: Column) -> Column:
    """array(variant) of the objects in the blocks: a top-level array is unfolded, and an object
    with an array `@graph` is replaced by the graph's objects."""

    def is_object(v):
        return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))

    entries = F.flatten(
        F.transform(
            F.filter(values, lambda v: v.isNotNull()),
            lambda v: F.coalesce(_at(v, "$", "array<variant>"), F.array(v)),
        )
    )
    unfolded = F.flatten(
        F.transform(
            F.filter(entries, is_object),
            lambda e: F.coalesce(_at(e, "$['@graph']", "array<variant>"), F.array(e)),
        )
    )
    return F.filter(unfolded, is_object)


def type_names(obj: Column) -> Column:
    """Lower-case `@type` names of an object; a single name or a list of names."""
    kind = _at(obj, "$['@type']", "variant")
    listed = F.coalesce(_at(kind, "$", "array<variant>"), F.array(kind))
    return F.transform(
        F.filter(listed, lambda t: F.schema_of_variant(t) == "STRING"),
        lambda t: F.lower(_at(t, "$", "string")),
    )


def truthy(obj: Column, path: str) -> Column:
    """The field exists and is not null, false, zero or an empty text."""
    value = _at(obj, path, "variant")
    schema = F.schema_of_variant(value)
    number = F.coalesce(_at(value, "$", "double"), F.lit(1.0))
    return (
        F.when(value.isNull() | schema.isNull() | (schema == "VOID"), False)
        .when(schema == "STRING", _at(value, "$", "string") != "")
        .when(schema == "BOOLEAN", _at(value, "$", "boolean"))
        .when(schema.startswith("OBJECT") | schema.startswith("ARRAY"), True)
        .otherwise(number != 0)
    )


def has_type(names: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(names, F.array(*[F.lit(w.lower()) for w in wanted]))


def with_type(objs: DataFrame, wanted: list[str], types: str = "types") -> DataFrame:
    """Rows of a long object table whose `@type` is one of `wanted`."""
    return objs.filter(has_type(F.col(types), wanted))


def _rating(obj: Column) -> Column:
    """The rating object of an entry: embedded, or the entry itself."""
    embedded = _at(obj, "$.aggregateRating", "variant")
    own = _at(_at(obj, "$['@type']", "variant"), "$", "string") == "AggregateRating"
    null_like = embedded.isNull() | (F.schema_of_variant(embedded) == "VOID")
    return F.when(~null_like, embedded).when(own, obj)


def _leading_number(text: Column, integer: bool = False) -> Column:
    """Number at the start of a text, null when there is none."""
    pattern = r"^\s*([+-]?\d+)" if integer else r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")


def summary(objs: Column) -> Column:
    """array(struct) with only the fields the checks read, one per object."""

    def one(o):
        names = type_names(o)
        rating = _rating(o)
        listed = F.coalesce(
            _at(rating, "$.reviewCount", "string"), _at(rating, "$.ratingCount", "string"), F.lit("0")
        )
        has_value = _at(rating, "$.ratingValue", "variant").isNotNull()
        count = _leading_number(listed, integer=True)
        return F.struct(
            names.alias("types"),
            F.when(
                F.schema_of_variant(_at(o, "$.name", "variant")) == "STRING",
                F.nullif(js_trim(_at(o, "$.name", "string")), F.lit("")),
            ).alias("name"),
            truthy(o, "$.name").alias("has_name"),
            truthy(o, "$.url").alias("has_url"),
            truthy(o, "$.logo").alias("has_logo"),
            truthy(o, "$.address").alias("has_address"),
            truthy(o, "$.telephone").alias("has_phone"),
            (truthy(o, "$.openingHours") | truthy(o, "$.openingHoursSpecification")).alias("has_hours"),
            (truthy(o, "$.aggregateRating") | truthy(o, "$.review")).alias("has_rating"),
            F.when(has_value, _leading_number(_at(rating, "$.ratingValue", "string"))).alias("rating"),
            F.when(has_value & (count > 0), F.least(count, F.lit(MOST_REVIEWS)).cast("bigint")).alias("reviews"),
        )

    return F.transform(objs, one)


def jsonld_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Long table (key, ord, raw, is_valid)."""
    blocks = raw_blocks(H.strip_comments(F.col(html)))
    return unfold(pages, key, blocks, "raw").withColumn("is_valid", whole_json(F.col("raw")).isNotNull())


def jsonld_objects(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Long table (key, ord, types, ...) of flattened objects."""
    blocks = pages.select(key, raw_blocks(H.strip_comments(F.col(html))).alias("_blocks"))
    return unfold(blocks, key, summary(objects(parsed(F.col("_blocks")))), "o").select(key, "ord", "o.*")
