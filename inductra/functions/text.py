"""Text expressions: keys, cleaning, defaults, escaping, data URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a browser's trim() removes, once as a list, once as a pattern.
SPACES = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WHITESPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# What comes before the comma of an accepted photo data URL, and the line
# breaks its payload must not contain.
DATA_URL_HEAD = r"^data:(image/[a-zA-Z0-9.+-]+);base64\z"
LINE_BREAKS = ("\n", "\r", "\u2028", "\u2029")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_all(value: Column | str) -> Column:
    """Strip every kind of outer whitespace; SQL ``trim`` strips spaces only."""
    return F.trim(_col(value), F.lit(SPACES))


def code_key(value: Column | str) -> Column:
    """Employee codes match without regard to case or outer spaces."""
    return F.upper(F.trim(_col(value)))


def email_key(value: Column | str) -> Column:
    return F.lower(F.trim(_col(value)))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(trim_all(value), F.lit(""))


def or_default(value: Column | str, default: str) -> Column:
    """``default`` for a missing or empty string."""
    return F.coalesce(F.nullif(_col(value), F.lit("")), F.lit(default))


def is_given(value: Column | str) -> Column:
    """True for a non-empty string, never NULL."""
    return F.coalesce(_col(value) != "", F.lit(False))


def escape_html(value: Column | str, apostrophe: str = "&#039;") -> Column:
    """The two callers of this rule spell the apostrophe ``&#039;`` and ``&#39;``."""
    out = F.coalesce(_col(value), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def strip_fences(value: Column | str) -> Column:
    """Drop the Markdown fence a model may put around its JSON."""
    plain = trim_all(F.coalesce(_col(value), F.lit("")))
    out = F.regexp_replace(plain, f"(?i)^```json{WHITESPACE}*", "")
    out = F.regexp_replace(out, f"^```{WHITESPACE}*", "")
    out = F.regexp_replace(out, f"```{WHITESPACE}*\\z", "")
    return F.when(plain.contains("```"), trim_all(out)).otherwise(plain)


def data_url_mime(value: Column | str) -> Column:
    """Mime type of a photo data URL, NULL when the text is not one.

    Only the short head meets a regular expression; the payload may be megabytes.
    """
    value = _col(value)
    head = F.substring_index(value, ",", 1)
    mime = F.nullif(F.regexp_extract(head, DATA_URL_HEAD, 1), F.lit(""))
    fine = F.octet_length(value) > F.octet_length(head) + 1
    for line_break in LINE_BREAKS:
        fine = fine & ~value.contains(line_break)
    return F.when(fine, mime)


def data_url_payload(value: Column | str) -> Column:
    """The base64 text after the head; NULL when the text is not a photo data URL."""
    value = _col(value)
    rest = F.substr(value, F.length(F.substring_index(value, ",", 1)) + 2)
    return F.when(data_url_mime(value).isNotNull(), rest)


def bare_content_type(value: Column | str) -> Column:
    """Content type without parameters; JPEG when the header is missing."""
    return F.split_part(or_default(value, "image/jpeg"), F.lit(";"), F.lit(1))


def padded_number(number: Column, width: int) -> Column:
    """Left-pad with zeros; a number wider than ``width`` keeps all its digits."""
    digits = number.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
