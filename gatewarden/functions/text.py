"""Column expressions for the text rules the gateway applies with Python
string methods, re-stated so Spark's Java-based functions give the same
answer.  All are built-in expressions (codegen'd, no UDF).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

# Characters Python's str.isspace() accepts (used by str.strip()).
# Java's \s misses most of these; Spark's trim() only removes spaces.
PY_WHITESPACE_CLASS = (
    r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Line boundaries of Python's str.splitlines(): CRLF, then the single ones.
PY_LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same set as single characters, for a cheap first/last-character test.
PY_WHITESPACE_CHARS = (
    ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85", "\xa0", "\u1680"]
    + [chr(c) for c in range(0x2000, 0x200B)]
    + ["\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
)


def py_strip(c: str | Column) -> Column:
    """``str.strip()`` with Python's notion of whitespace.

    The regex only runs when the first or last character is whitespace;
    most values have neither, and pay a set-membership test instead.
    """
    ws = PY_WHITESPACE_CLASS
    v = _col(c)
    edge = F.substring(v, 1, 1).isin(*PY_WHITESPACE_CHARS) | F.substring(v, -1, 1).isin(*PY_WHITESPACE_CHARS)
    return F.when(edge, F.regexp_replace(v, f"^[{ws}]+|[{ws}]+$", "")).otherwise(v)


def py_rstrip(c: str | Column) -> Column:
    """``str.rstrip()`` with Python's notion of whitespace (regex only when the
    last character is whitespace)."""
    v = _col(c)
    edge = F.substring(v, -1, 1).isin(*PY_WHITESPACE_CHARS)
    return F.when(edge, F.regexp_replace(v, f"[{PY_WHITESPACE_CLASS}]+$", "")).otherwise(v)


def split_lines(c: str | Column) -> Column:
    """``str.splitlines()`` as an array (may end with one empty element,
    which the callers drop as a blank line)."""
    return F.split(_col(c), PY_LINE_BREAK)


def unquote_once(v: str | Column) -> Column:
    """Remove one matching pair of ``"`` or ``'`` around a value of length >= 2."""
    v = _col(v)
    first = F.substring(v, 1, 1)
    last = F.substring(v, -1, 1)
    quoted = (F.length(v) >= 2) & (first == last) & first.isin('"', "'")
    return F.when(quoted, v.substr(F.lit(2), F.length(v) - 2)).otherwise(v)


def strip_colour(c: str | Column) -> Column:
    """Remove ``ESC [ digits/semicolons m`` colour codes only."""
    return F.regexp_replace(_col(c), r"\x{1B}\[[0-9;]*m", "")


def bool_like(v: str | Column) -> Column:
    """Channel rule: non-empty and not false/0/no in any case; null-safe."""
    v = _col(v)
    return F.coalesce((F.length(v) > 0) & ~F.lower(v).isin(*C.FALSE_WORDS), F.lit(False))


def truthy(v: str | Column) -> Column:
    """Plain truthiness of a settings value (non-empty string)."""
    return F.coalesce(F.length(_col(v)) > 0, F.lit(False))


def slug(v: str | Column, empty: str = "custom") -> Column:
    """Lower case, every char outside ``[a-z0-9-]`` to ``-``, strip ``-``, empty -> ``empty``."""
    s = F.regexp_replace(F.lower(_col(v)), r"[^a-z0-9-]", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(empty))


def html_escape(c: str | Column) -> Column:
    """Escape ``& < > " '`` (``&`` first)."""
    s = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def quote_path(c: str | Column) -> Column:
    """Percent-encode like Python's ``urllib.parse.quote`` with ``safe='/'``.

    ``url_encode`` is form encoding (space -> ``+``, ``/`` and ``~`` encoded);
    undo those three differences.
    """
    s = F.url_encode(_col(c))
    s = F.replace(s, F.lit("+"), F.lit("%20"))
    s = F.replace(s, F.lit("%2F"), F.lit("/"))
    s = F.replace(s, F.lit("%7E"), F.lit("~"))
    s = F.replace(s, F.lit("*"), F.lit("%2A"))
    return s


def provider_label(key: str) -> str:
    """Display name of a provider key: the key without its API-key and token
    parts, underscores as blanks, each word capitalised."""
    shown = re.sub("_API_KEY|_TOKEN", "", key)
    shown = shown.replace("HF_", "HuggingFace ")  # only a longer HF key still has its prefix here
    return " ".join(word.capitalize() for word in shown.replace("_", " ").split(" "))
