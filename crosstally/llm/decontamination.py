"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased, with every run of white space as one blank. A test item of m
characters may differ in ``k = floor(m * error_rate)`` edits. Cut into k + 1 pieces, at least one piece
must occur unchanged wherever the item does (pigeonhole), so all pieces are sought at once with an
Aho-Corasick automaton, and each hit is settled by Myers' bit-parallel edit distance on the window
that could hold the item.

Items of fewer than ``whole_below`` characters, in which an edit would leave little, match without any edit and
only as whole words: no letter or digit stands right before or after.

Defined results: null and empty documents match nothing; null items and items of white space match nothing;
items of equal text are each reported; rows of equal id are joined into one result per (doc_id, item_id), the best; empty
tables give no rows; other columns are ignored.

Scale: documents are never shuffled. The items are a query set taken in blocks of at most about
``block_chars`` characters (a fixed bound on what is sent to the tasks), one pass over the
documents per block. A worker builds a block's automaton once, for all its tasks.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstally.llm.frames import picked

ERROR_RATE = 0.05
WHOLE_BELOW = 24
BLOCK_CHARS = 4_000_000


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """Bounds of ``errors + 1`` nearly equal pieces."""
    edges = [length * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(edges, edges[1:]))


def peq(pattern: str) -> dict[str, int]:
    """For each character a bit mask of its places in the pattern."""
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


def myers(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the pattern inside ``text``, if at most ``most``.

    Columns of the edit matrix are kept as bit vectors of vertical differences (Myers 1999).
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best: tuple[int, int] | None = None
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up = down | (full & ~(diagonal | up))
        right_down = up & diagonal
        if right_up & top:
            distance += 1
        elif right_down & top:
            distance -= 1
        right_up = (right_up << 1) & full
        right_down = (right_down << 1) & full
        up = right_down | (full & ~(diagonal | right_up))
        down = right_up & diagonal
        if distance <= most and (best is None or distance < best[0]):
            best = (distance, end)
    return best


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] neither begins nor ends inside a word."""
    return not (
        (start and text[start].isalnum() and text[start - 1].isalnum())
        or (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())
    )


#: The automaton of the block that this worker matched last, under the name of the block.
_BUILT: dict[str, Matcher] = {}


def _built(name: str, *arguments) -> Matcher:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Matcher(*arguments)
    return _BUILT[name]


class Matcher:
    """Finds one block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, whole_below: int):
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.items = []
        by_text: dict[str, int] = {}
        for item_id, text in items:
            text = normalised(text)
            if not text:
                continue
            if text in by_text:
                self.items[by_text[text]][0].append(item_id)
                continue
            n = by_text[text] = len(self.items)
            whole = len(text) < whole_below
            errors = 0 if whole else int(len(text) * error_rate)
            self.items.append(([item_id], text, errors, peq(text), whole))
            for low, high in pieces(len(text), errors):
                where[text[low:high]].append((n, low))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, errors, start, end) of the best match per item; bounds in the normalised
        text, ``start`` the earliest at which the window's match can begin."""
        if not self.items or not (text := normalised(text)):
            return []
        begins: dict[int, set[int]] = defaultdict(set)
        for end, (length, places) in self.automaton.iter(text):
            for n, low in places:
                begins[n].add(end + 1 - length - low)
        out = []
        for n, starts in begins.items():
            ids, item, errors, masks, whole = self.items[n]
            if whole:
                # The one piece is the item itself.
                starts = {s for s in starts if _stands_alone(text, s, s + len(item))}
                out.extend((i, 0, s, s + len(item)) for s in sorted(starts)[:1] for i in ids)
                continue
            best, open_to, low = None, None, None
            # Windows of hits that lie within the error budget of each other are settled in one.
            for start in [*sorted(starts), None]:
                if open_to is not None and (start is None or start - errors > open_to):
                    window = text[max(0, low - errors) : open_to + len(item) + errors]
                    if found := myers(masks, len(item), window, errors):
                        end = max(0, low - errors) + found[1]
                        got = (found[0], max(0, end - len(item) - errors if found[0] else end - len(item)), end)
                        best = min(best or got, got)
                    open_to = None
                if start is not None:
                    low = start if open_to is None else low
                    open_to = start
            if best:
                out.extend((item_id, *best) for item_id in ids)
        return out


def find_leaks(
    docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, whole_below: int = WHOLE_BELOW,
    block_chars: int = BLOCK_CHARS, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, errors, start, end: which documents hold which items."""
    docs = picked(docs, doc_id=doc_id, text=text)
    items = picked(items, item_id=item_id, text=item_text).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    kinds = [docs.schema["doc_id"].dataType, items.schema["item_id"].dataType]
    schema = (
        f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, "
        "errors int, start long, end long"
    )
    found = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        own = _matched(docs, sorted((tuple(r) for r in rows), key=repr), error_rate, whole_below, schema)
        found = own if found is None else found.unionByName(own)
    best = F.min(F.struct("errors", "start", "end")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _matched(docs, rows, error_rate, whole_below, schema) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _built(name, shared.value, error_rate, whole_below)
        for batch in batches:
            at, hits = [], []
            for i, text in enumerate(batch.column("text")):
                found = matcher(text.as_py())
                at.extend([i] * len(found))
                hits.extend(found)
            columns = list(zip(*hits)) if hits else [(), (), (), ()]
            names = ["item_id", "errors", "start", "end"]
            types = [None, pa.int32(), pa.int64(), pa.int64()]
            arrays = [pa.array(list(c), t) if t else pa.array(list(c)) for c, t in zip(columns, types)]
            if hits:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at, pa.int32())), *arrays], ["doc_id", *names]
                )

    return docs.mapInArrow(matched, schema)


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no item; a null id is kept only if no null id has a leak."""
    marked = leaks.select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(marked, docs[doc_id].eqNullSafe(marked["__leaked"]), "left_anti")
