"""Column builders for HTML: references, tags, marked blocks, JSON in attributes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from priceengine.functions.scalars import ENTITIES, half_up, let


def _character(code: Column) -> Column:
    """The character of a code point; null beyond Unicode."""
    return F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decoded(text: Column) -> Column:
    """References replaced: the named ones in their fixed order (so `&amp;lt;` becomes `<`), then decimal, then hexadecimal ones."""
    out = text
    for name, by in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(by))

    def numbers(s: Column, pattern: str, code: Callable[[Column], Column]) -> Column:
        """Every different reference replaced; most texts have none and skip the loop."""
        def each(x: Column) -> Column:
            found = F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), 0))
            return F.when(F.contains(x, F.lit("&#")), F.aggregate(found, x, lambda t, r: F.replace(t, r, F.coalesce(let(code(r), _character), r)))).otherwise(x)

        return let(s, each)

    out = numbers(out, r"&#\d{1,7};", lambda r: F.regexp_extract(r, r"\d+", 0).cast("long"))
    return numbers(out, r"(?i)&#x[\da-f]{1,6};", lambda r: F.conv(F.regexp_extract(r, r"(?i)&#x([\da-f]+);", 1), 16, 10).cast("long"))


def visible(html: Column) -> Column:
    """The text without tags, references decoded, white space collapsed."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(html, r"<[^>]*>", " ")), r"\s+", " "))


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's text, or null where the pattern is not found."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def blocks(html: Column, marker: str) -> Column:
    """The text cut before every match of `marker`, without what stands before the first."""
    parts = F.split(html, f"(?={marker})")
    return F.filter(parts, lambda p: p.rlike(f"^(?:{marker})"))


def page_count(html: Column) -> Column:
    """The largest number in `aria-label="Page N"`, 1 at least."""
    pages = F.transform(F.regexp_extract_all(html, F.lit(r'aria-label="Page (\d+)"'), 1), lambda p: p.cast("long"))
    return F.greatest(F.lit(1).cast("long"), F.coalesce(F.array_max(pages), F.lit(1).cast("long")))


def item_count(html: Column) -> Column:
    """N of `of N products` or `of N results`, or null."""
    found = F.replace(F.regexp_extract(html, r"(?i)of\s+([\d,]+)\s+(?:products|results)", 1), F.lit(","), F.lit(""))
    return F.when(found != "", found).cast("long")


def multibuy(callout: Column) -> Column:
    """struct<quantity, total_cents, unit_cents> of `3 for $10`, or null."""
    pattern = r"(?i)(\d+)\s+for\s+\$\s*([\d,]+(?:\.\d{1,2})?)"
    found = F.struct(
        F.regexp_extract(callout, pattern, 1).try_cast("long").alias("n"),
        half_up(F.replace(F.regexp_extract(callout, pattern, 2), F.lit(","), F.lit("")).try_cast("double") * F.lit(100.0)).alias("total"),
    )

    def offer(x: Column) -> Column:
        unit = half_up(F.try_divide(x["total"].cast("double"), x["n"].cast("double")))
        return F.when((x["n"] > 0) & x["total"].isNotNull(), F.struct(x["n"].alias("quantity"), x["total"].alias("total_cents"), unit.alias("unit_cents")))

    return let(found, offer)


def best_image(images: Column) -> Column:
    """Of JSON text: a string is itself, a list gives its first non-empty entry, an object the entry with the largest numeric key."""
    def best(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        entries = F.map_entries(F.try_variant_get(value, "$", "map<string,string>"))
        numbered = F.filter(F.transform(entries, lambda e: F.struct(e["key"].try_cast("double").alias("n"), e["value"].alias("url"))), lambda e: e["n"].isNotNull())
        listed = F.filter(F.try_variant_get(value, "$", "array<string>"), lambda u: u != "")
        return (
            F.when(kind == "STRING", F.nullif(F.try_variant_get(value, "$", "string"), F.lit("")))
            .when(kind.startswith("ARRAY"), F.try_element_at(listed, F.lit(1)))
            .when(kind.startswith("OBJECT"), F.array_max(numbered)["url"])
        )

    return let(F.try_parse_json(images), best)
