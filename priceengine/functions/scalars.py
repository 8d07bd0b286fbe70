"""Column builders for numbers, texts and identifiers. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of retailers as they are shown.
RETAILERS = {
    "paknsave": "PAK'nSAVE",
    "newworld": "New World",
    "woolworths": "Woolworths",
    "freshchoice": "FreshChoice",
    "warehouse": "The Warehouse",
}
# Words that say nothing in a product's name.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "with", "is", "it", "by", "&")
# The score of a pair of names.
FUZZY_THRESHOLD, BRAND_BONUS, QUANTITY_BONUS = 0.4, 0.15, 0.1
# Units that a size may have.
UNITS = ("g", "kg", "ml", "l", "lt", "each", "pack", "count", "dozen", "ea")
# Named references in the order in which they are decoded.
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "))
# Secrets in messages, in the order in which they are blanked.
SECRETS = (
    (r"Bearer\s+[a-zA-Z0-9._\-+/=]{8,}", "Bearer **REDACTED**"),
    (r"(?i)x-auth-token\s*[:=]\s*[^\s;\"'&),\]}]{4,}", "x-auth-token: **REDACTED**"),
    (r"(?i)authorization\s*[:=]\s*Bearer\s+[a-zA-Z0-9._\-+/=]{8,}", "authorization: Bearer **REDACTED**"),
    (r"(?i)session[_-]?id\s*[:=]\s*[^\s;\"'&),\]}]{4,}", "session-id: **REDACTED**"),
    (r"(?i)(?:(?:^|[\s;\"'(\[{,])(cookie|token|secret|api[_-]?key|password|auth))\s*[:=]\s*[\"']?[^\s;\"'&),\]}]{4,}", "$1=**REDACTED**"),
)
MESSAGE_CHARS = 1000
# What in the lower-cased output of a failed run names its kind; the first that fits counts.
FAILURES = (
    ("timeout", ("timeouterror", "timed out", "abortederror", "abortsignal", 'signal: "sigterm"', 'signal: "sigkill"')),
    ("rate_limited", ("429", "too many requests")),
    ("server_error", ("502", "503", "504")),
    ("network", ("econnrefused", "etimedout", "enotfound", "econnreset")),
)
PRODUCT_ID = r"^[a-z]+:[a-zA-Z0-9_-]+$"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def half_up(x: Column) -> Column:
    """The nearest whole number; halves go towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def percent2(x: Column) -> Column:
    """Two decimals, halves up."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)


def saved_percent(before: Column, now: Column) -> Column:
    """What share of `before` is saved; null where there is no price before."""
    return percent2(F.try_divide((before - now).cast("double"), before.cast("double")) * F.lit(100.0))


def dollars_to_cents(x: Column) -> Column:
    return half_up(x.cast("double") * F.lit(100.0))


def money(text: Column) -> Column:
    """Cents of the first `$1,234.50` in a text, or null."""
    found = F.replace(F.regexp_extract(text, r"\$\s*([\d,]+(?:\.\d{1,2})?)", 1), F.lit(","), F.lit(""))
    return half_up(found.try_cast("double") * F.lit(100.0))


def cents_text(cents: Column) -> Column:
    """`$1,234.50`; nothing for null."""
    return F.when(cents.isNull(), "").otherwise(F.format_string("$%,.2f", cents.cast("double") / F.lit(100.0)))


def date_text(at: Column, year: bool = True) -> Column:
    """`5 Jul 2026`, or `5 Jul`; nothing for null."""
    return F.coalesce(F.date_format(at, "d MMM yyyy" if year else "d MMM"), F.lit(""))


def relative_text(at: Column, now: Column) -> Column:
    """How long ago, in whole minutes, hours or days; from 30 days on the date."""
    minutes = F.timestamp_diff("MINUTE", at, now)
    ago = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(at.isNull(), "").when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "m")).when(minutes < 24 * 60, ago(minutes / 60, "h"))
        .when(minutes < 30 * 24 * 60, ago(minutes / (24 * 60), "d")).otherwise(date_text(at))
    )


def url_part(text: Column) -> Column:
    """A text as part of a query string: spaces as %20, and `!~'()` stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for mark in "!~'()":
        out = F.replace(out, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    return out


def in_range(value: float | None, low: float, high: float, default: int) -> int:
    """`value` as a whole number if it lies in the range, else the default (not the nearer bound)."""
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    return int(number // 1) if low <= number <= high else default


def plain(text: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(""))


def gtin(code: Column) -> Column:
    """8 to 14 digits without white space, leading zeros kept, or null."""
    bare = F.regexp_replace(code, r"\s+", "")
    return F.when(bare.rlike(r"^[0-9]{8,14}$"), bare)


def name_tokens(name: Column) -> Column:
    """Words of two letters or more that are no stop words; repeated ones stay."""
    words = F.regexp_extract_all(F.lower(name), F.lit(r"[\w']{2,}+"), 0)  # what other characters part; a single one is no word
    return F.coalesce(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all different tokens; 0 if there are none."""
    sizes = F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("either"))
    return let(sizes, lambda n: F.when(n["either"] == 0, F.lit(0.0)).otherwise(n["both"].cast("double") / n["either"].cast("double")))


def quantity(size: Column) -> Column:
    """struct<value double, unit string> of sizes such as `1.5 kg`, or null."""
    pattern = rf"(?i)^(\d+(?:\.\d+)?)\s*({'|'.join(UNITS)})$"
    found = F.struct(F.regexp_extract(F.trim(size), pattern, 1).try_cast("double").alias("value"), F.lower(F.regexp_extract(F.trim(size), pattern, 2)).alias("unit"))
    return let(found, lambda q: F.when(q["unit"] != "", F.struct(q["value"].alias("value"), F.when(q["unit"] == "lt", "l").otherwise(q["unit"]).alias("unit"))))


def name_score(tokens_a: Column, tokens_b: Column, brand_a: Column, brand_b: Column, size_a: Column, size_b: Column) -> Column:
    """The uncapped score of two products: shared name tokens, plus bonuses for the same brand and the same size."""
    same_brand = F.coalesce(plain(brand_a) == plain(brand_b), F.lit(False))
    same_size = F.coalesce(quantity(size_a) == quantity(size_b), F.lit(False))
    return jaccard(tokens_a, tokens_b) + F.when(same_brand, F.lit(BRAND_BONUS)).otherwise(F.lit(0.0)) + F.when(same_size, F.lit(QUANTITY_BONUS)).otherwise(F.lit(0.0))


def evidence(*parts: Column) -> Column:
    """A hash of what a decision rests on; null parts are empty."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def content_hash(*parts: Column) -> Column:
    """A hash over columns in the given order that tells null from empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]), 256)


def namespace(identifier: Column) -> Column:
    return F.substring_index(identifier, ":", 1)


def after_namespace(identifier: Column) -> Column:
    """What follows the first colon; all of it if there is none."""
    return F.regexp_replace(identifier, r"^[^:]*:", "")


def retailer_label(retailer: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in RETAILERS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, retailer), retailer)


def title_slug(slug: Column) -> Column:
    """`royal-oak` as `Royal Oak`; only first letters change."""
    parts = F.filter(F.split(slug, "-"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.char_length(p)))), " ")


def redacted(text: Column) -> Column:
    """Secrets blanked, then cut to MESSAGE_CHARS."""
    out = F.coalesce(text, F.lit(""))
    for pattern, by in SECRETS:
        out = F.regexp_replace(out, pattern, by)
    return F.substring(out, 1, MESSAGE_CHARS)


def run_kind(exit_code: Column, output: Column) -> Column:
    """success, timeout, rate_limited, server_error, network or failure."""
    said = F.lower(F.coalesce(output, F.lit("")))
    out = F.when(exit_code == 0, "success").when(exit_code > 128, "timeout")
    for kind, signs in FAILURES:
        hit = F.lit(False)
        for sign in signs:
            hit = hit | F.contains(said, F.lit(sign))
        out = out.when(hit, kind)
    return out.otherwise("failure")


def freshness(age_days: Column) -> Column:
    return F.when(age_days.isNull(), "none").when(age_days <= 7, "fresh").when(age_days <= 14, "stale").otherwise("old")


def escaped_like(text: str) -> str:
    """`text` as a literal inside a LIKE pattern."""
    return "".join("\\" + c if c in "\\%_" else c for c in text)
