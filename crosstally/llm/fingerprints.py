"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken 2003), in built-in functions only.

Tokens are words (long ones in pieces of ``TOKEN`` characters). Every run of ``GRAM`` tokens is hashed; of every
``WINDOW`` neighbouring hashes the least is chosen, the rightmost where equal. So any passage of
``GRAM + WINDOW - 1`` tokens that two texts share gives both a common fingerprint, and none shorter than
``GRAM`` tokens does. Positions (token numbers from 0) are kept with the hashes.

A regular expression with a look-ahead yields the overlapping grams in one call. The hash and the position of a
gram share one long (hash above, position counted down below), so a plain minimum picks the least
hash and the rightmost place; window minima double their span (2, then 4) instead of visiting each
window's members.

Defined results: null and empty texts and texts of white space have no fingerprint; a text of fewer
tokens than a gram has one, the hash of its trimmed text at position 0; fewer grams than a window form
one window; other columns are ignored.

Scale: fingerprints are computed row by row, without a shuffle, in memory that follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstally.llm.frames import picked, stored

GRAM, WINDOW, TOKEN = 4, 4, 32
_PLACE_BITS = 30
_LAST = (1 << _PLACE_BITS) - 1
_WHITE = r"[\x20\x09-\x0D]+"
_LONG = rf"([^ ]{{{TOKEN}}})(?=[^ ])"
_GRAMS = rf"(?<![^ ])(?=([^ ]+(?: [^ ]+){{{GRAM - 1}}}))"
DOCS_PER_BUCKET = 256


def _doubled(minima: str, by: int) -> Column:
    """Minima of spans of 2 * ``by`` from those of spans of ``by``; spans past the end are cut short."""
    later = F.slice(minima, by + 1, F.greatest(F.size(minima), F.lit(1)))
    return F.zip_with(minima, later, lambda a, b: F.least(a, b))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` and two arrays: ``name`` (hashes in order of position) and ``name_at`` (their positions).

    Each step is a column of its own, so that no array is computed twice.
    """
    plain, found, keys = f"__{name}_plain", f"__{name}_grams", f"__{name}_keys"
    bare = F.btrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _WHITE, " "))
    df = df.withColumn(plain, F.regexp_replace(bare, _LONG, "$1 "))
    df = df.withColumn(found, F.regexp_extract_all(plain, F.lit(_GRAMS), F.lit(1)))
    # Texts of fewer tokens than a gram are one gram.
    df = df.withColumn(
        found, F.when((F.size(found) == 0) & (F.col(plain) != ""), F.array(plain)).otherwise(F.col(found))
    )
    key = lambda g, i: F.shiftleft(F.shiftright(F.xxhash64(g), _PLACE_BITS + 1), _PLACE_BITS).bitwiseOR(
        F.lit(_LAST) - i.cast("long")
    )
    df = df.withColumn(keys, F.transform(found, key))
    span = 1
    while span < WINDOW:
        df = df.withColumn(keys, _doubled(keys, span))
        span *= 2
    windows = F.slice(keys, 1, F.greatest(F.size(keys) - (WINDOW - 1), F.lit(1)))
    df = df.withColumn(keys, F.array_distinct(windows))
    df = df.withColumn(
        f"{name}_at", F.transform(keys, lambda k: (F.lit(_LAST) - k.bitwiseAND(F.lit(_LAST))).cast("int"))
    )
    df = df.withColumn(name, F.transform(f"{name}_at", lambda at: F.xxhash64(F.get(found, at))))
    return df.drop(plain, found, keys)


def likeness(one: Column, other: Column) -> Column:
    """Twice the shared hashes over all hashes of both (0 to 1); two empty fingerprints are alike."""
    sizes = F.size(F.array_distinct(one)) + F.size(F.array_distinct(other))
    return F.when(sizes == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(one, other)) / sizes)


def as_text(hashes: Column) -> Column:
    return F.array_join(hashes.cast("array<string>"), ",")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, hashes, positions; one row per document."""
    docs = picked(docs, doc_id=doc_id, text=text)
    return with_fingerprint(docs, "text", "hashes").select("doc_id", "hashes", F.col("hashes_at").alias("positions"))


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) dealt out so that ``doc_id`` and its follower share a bucket.

    Adds ``bucket`` and ``guest``: a guest is the first document of the next bucket (after the last: of the
    first), lent to the bucket before it. Texts are shuffled once, with one in
    ``DOCS_PER_BUCKET`` twice. Buckets are ranges of equally many ids if ids are spread evenly.
    """
    n, low, high = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    width = max(1, (high - low + 1) * DOCS_PER_BUCKET // n) if low is not None else 1
    bucket = F.coalesce(F.expr(f"(doc_id - {low or 0}) div {width}"), F.lit(-1).cast("long"))
    hosts = docs.withColumn("bucket", bucket).withColumn("guest", F.lit(False))
    order = Window.orderBy("bucket")
    last = F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lent = stored(
        hosts.groupBy("bucket").agg(F.min("doc_id").alias("first"))
        .select("first", F.coalesce(F.lag("bucket").over(order), last).alias("to")),
        "lent",
    )
    guests = docs.join(lent, docs["doc_id"].eqNullSafe(lent["first"])).select(
        "doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("guest")
    )
    return hosts.unionByName(guests).repartition("bucket")


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document beside an edited text: its last half replaced by the start of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. "Next" is by
    ascending doc_id (an integer; null first; equal ids by a hash of the text).
    """
    docs = picked(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    dealt = with_fingerprint(beside_next(docs), "text", "own")
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", F.xxhash64("text"))
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    beside = (
        dealt.withColumns({"next_text": F.lead("text").over(order), "next": F.lead("own").over(order)})
        .where("not guest").select("doc_id", "text", "own", "next", edited.alias("edited"))
    )
    both = with_fingerprint(beside, "edited", "changed")
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
