"""Text columns: redaction, call signatures, signed amounts, JSON-safe structs, name matching."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosstally.functions.types import quoted

# Secret patterns, their replacements, and the line limit of a log preview.
API_KEY_PATTERN = r"sk-or-v1-[A-Za-z0-9_-]+"
API_KEY_MARK = "[REDACTED_API_KEY]"
BEARER_PATTERN = r"(?i)(authorization\s*[:=]\s*bearer\s+)[^\s,}\]]+"
BEARER_MARK = "[REDACTED]"
PREVIEW_LIMIT = 500

# White space other than the plain space.
WHITESPACE = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def redact(text: Column) -> Column:
    """Mask secrets and squeeze white space over the whole text."""
    masked = F.regexp_replace(text, API_KEY_PATTERN, API_KEY_MARK)
    masked = F.regexp_replace(masked, BEARER_PATTERN, "$1" + BEARER_MARK)
    # Most runs are single spaces already; a pattern over all white space would rewrite each.
    spaced = F.translate(masked, WHITESPACE, " " * len(WHITESPACE))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def shorten(line: Column, limit: int = PREVIEW_LIMIT) -> Column:
    """A line for display: ``limit`` characters and ``...`` when it is longer."""
    return F.when(F.length(line) > limit, F.concat(F.left(line, F.lit(limit)), F.lit("..."))).otherwise(line)


def log_line(text: Column, limit: int = PREVIEW_LIMIT) -> Column:
    """The redacted text (all of it is searched for secrets), shortened for display."""
    return shorten(redact(text), limit)


def canonical_json(arguments: dict[str, Any]) -> str:
    return json.dumps(arguments, sort_keys=True, default=str)


def call_signature(tool: Column, arguments_json: Column) -> Column:
    """First 16 hex digits of SHA-256 over ``tool:arguments``."""
    return F.substring(F.sha2(F.concat(tool, F.lit(":"), arguments_json), 256), 1, 16)


def signature_of(tool: str, arguments: dict[str, Any]) -> str:
    """The :func:`call_signature` of a call that has not been made yet."""
    return hashlib.sha256(f"{tool}:{canonical_json(arguments)}".encode()).hexdigest()[:16]


def signed_amount(value: Column) -> Column:
    """``+1,234.50``"""
    return F.format_string("%+,.2f", value.cast("double"))


def json_details(df: DataFrame, columns: Sequence[str]) -> Column:
    """Columns as one JSON text; NaN becomes null, nulls are kept."""
    fields = []
    for name in columns:
        value = quoted(name)
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            value = F.when(~F.isnan(value), value)
        fields.append(value.alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def normal_name(name: str) -> str:
    """Lower case, everything but letters and digits as single spaces."""
    return re.sub(r"[^a-z0-9]+", " ", name.lower()).strip()


def normal_text(text: Column) -> Column:
    """The same normalisation on data."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def has_whole_words(text: Column, words: str) -> Column:
    """Whether the normalised ``words`` occur in ``text`` as whole words."""
    return F.concat(F.lit(" "), normal_text(text), F.lit(" ")).contains(f" {normal_name(words)} ")
