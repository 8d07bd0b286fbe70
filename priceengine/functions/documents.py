"""JSON of any shape as text: one form for equal values, and secrets blanked by the name of their key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that tell a secret, those that form data may have, and what is put in its place.
SECRET_NAMES = "authorization|cookie|token|secret|password|api[-_]?key"
SECRET_FIELDS = "authorization|token|secret|password|api[-_]?key"
BLANK = "[REDACTED]"
#: Levels of brackets inside a secret value that the pattern follows.
DEPTH = 64

_STRING = r'"[^"]*+"'


def _brackets(depth: int) -> str:
    """A pattern of one bracketed value with all that stands in it; strings have no escaped quotes. Possessive throughout: linear, and no recursion but by level."""
    out = ""
    for _ in range(depth):
        out = rf'[\[{{](?:[^\[\]{{}}"]++|{_STRING}{"|" + out if out else ""})*+[\]}}]'
    return out


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of every object in order, at every level, without white space and with numbers and escapes in one form.

    Arrays keep their order. Null for what is no JSON, which an object with a key twice and more than a thousand levels are, too;
    what follows the first value is not looked at.
    """
    return F.to_json(F.try_parse_json(text))


def json_fingerprint(text: Column) -> Column:
    """The same for equal JSON values, however their keys stand, and another one for arrays in another order. Null for what is no JSON."""
    return F.sha2(canonical_json(text), 256)


def redacted_json(text: Column) -> Column:
    """JSON text, in its canonical form, with BLANK for every value whose key names a secret, at any level, arrays included; null for what is no JSON.

    A secret may be a whole tree, of up to DEPTH levels; of a text with more levels than that nothing is told but BLANK.
    """
    told = canonical_json(text)
    # control characters are escaped in JSON, so two of them can stand for escaped backslashes and quotes meanwhile
    plain = F.replace(F.replace(told, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    key = rf'(?<=[{{,])("[^"]*?(?i:{SECRET_NAMES})[^"]*+":)'
    blanked = F.regexp_replace(plain, rf'{key}(?:{_STRING}|{_brackets(DEPTH)}|[^,\[\]{{}}"]++)', f'$1"{BLANK}"')
    levels = F.regexp_replace(F.regexp_replace(plain, _STRING, ""), r"[^\[\]{}]", "")
    out = F.when(levels.rlike(rf"^(?:{_brackets(DEPTH)})?$"), blanked).otherwise(F.lit(f'"{BLANK}"'))
    out = F.when(plain.rlike(key), out).otherwise(plain)
    return F.replace(F.replace(out, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def redacted_form(text: Column) -> Column:
    """Form data with BLANK for the values of secret fields."""
    return F.regexp_replace(text, rf"(?i)((?:{SECRET_FIELDS})=)[^&]*", f"$1{BLANK}")


def redacted_body(text: Column) -> Column:
    """What was sent: as JSON if it is, else as form data."""
    return F.coalesce(redacted_json(text), redacted_form(text))


def redacted_header(name: Column, value: Column) -> Column:
    return F.when(name.rlike(f"(?i){SECRET_NAMES}"), F.lit(BLANK)).otherwise(value)
