"""Problem 2: oversized texts cut into pieces at natural boundaries.

A text is read as a tree: sections under headings, blocks between blank lines, lists and tables inside a block, their
outer items, lines, sentences, clauses, words.  Neighbouring siblings are merged while they fit into a piece, and only
nodes that are too large are entered; what is left at the end of such a node is not merged with the node after it.  An
unbroken string longer than a piece is cut between characters, never inside a combining sequence.

Each piece after the first begins with the last `overlap` characters of the piece before, or with fewer, to begin at a
sentence, line or word.  `page_start` follows form feeds in the text or, without any, the piece's place between
`page_start` and `page_end`.

Results by case: null and short texts give no piece here (they are no oversized items; `pieces(whole=True)` passes them
through as one piece); a re-delivered row counts once, in its latest delivery; null pages and titles stay null; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2400, 200

_LISTED = re.compile(r"[^\S\n]*(?:[-*•+]\s|\d{1,3}[.)]\s|\|)")


class _Lists:
    """Where a list or table begins or ends between two lines of a block; used like a pattern."""

    def finditer(self, text: str, begin: int, end: int):
        before = None
        for m in _LINES.finditer(text, begin, end):
            listed = bool(_LISTED.match(text, m.start()))
            deeper = before and text[m.start()] in " \t"  # a line that goes on under its item
            if before is not None and listed != before and not deeper:
                yield _Place(m.start())
            before = listed or bool(deeper)


class _Place:
    def __init__(self, at: int):
        self.at = at

    def end(self) -> int:
        return self.at


_LINES = re.compile(r"^(?=.)", re.M)
#: Where a node of each level begins: headings by depth, blocks, lists and tables, outer items, lines, sentences,
#: clauses, words.
LEVELS = [
    *[re.compile(rf"^(?=#{{1,{depth}}} )", re.M) for depth in range(1, 7)],
    re.compile(r"(?<=\f)|\n[^\S\n]*\n\s*(?=\S)"),
    _Lists(),
    re.compile(r"(?<=\n)(?=[-*•+]\s|\d{1,3}[.)]\s|\|)"),
    re.compile(r"(?<=\n)(?=[^\S\n]*\S)"),
    re.compile(r"(?<=[.!?…])[\"')\]”’]*\s+(?=\S)|(?<=[。!?…])[”’」』)]*(?=\S)"),
    re.compile(r"(?<=[;:,])\s+(?=\S)|(?<=[;:,、])(?=\S)"),
    re.compile(r"\s+(?=\S)"),
]
_SENTENCE, _WORD = len(LEVELS) - 3, len(LEVELS) - 1


def _starts(text: str, begin: int, end: int, level: int) -> list[int]:
    """Begins of the nodes of a level inside a span, without the span's own begin."""
    found = []
    for m in LEVELS[level].finditer(text, begin, end):
        if begin < m.end() < end and (not found or m.end() > found[-1]):
            found.append(m.end())
    return found


def _hard(text: str, begin: int, end: int, size: int) -> list[tuple[int, int]]:
    out = []
    while end - begin > size:
        cut = begin + size
        while cut > begin + size // 2 and (unicodedata.combining(text[cut]) or text[cut] in "‍️" or text[cut - 1] == "‍"):
            cut -= 1
        out.append((begin, cut))
        begin = cut
    return [*out, (begin, end)]


def _pack(text: str, begin: int, end: int, level: int, size: int) -> list[tuple[int, int]]:
    """Spans of at most `size` that cover [begin, end), as few and as high in the tree as merging gets them."""
    if end - begin <= size:
        return [(begin, end)]
    while level < len(LEVELS):
        borders = _starts(text, begin, end, level)
        level += 1
        if borders:
            break
    else:
        return _hard(text, begin, end, size)
    out: list[tuple[int, int]] = []
    merging = False  # whether the last span consists of whole siblings
    for a, b in zip([begin, *borders], [*borders, end]):
        if b - a > size:
            out += _pack(text, a, b, level, size)
            merging = False
        elif merging and b - out[-1][0] <= size:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
            merging = True
    return out


def _overlap_start(text: str, begin: int, floor: int, overlap: int) -> int:
    """Where a piece whose own part begins at `begin` starts: `overlap` before it, or later, at a boundary."""
    at = max(floor, begin - overlap)
    if at <= floor or begin - at < 2:
        return at
    window = range(at, begin - overlap // 2)
    for level in (_SENTENCE, _SENTENCE - 1):
        for m in LEVELS[level].finditer(text, max(0, at - 1), begin):
            if m.end() in window:
                return m.end()
    for m in LEVELS[_WORD].finditer(text, max(0, at - 1), begin):
        if at <= m.end() < begin:
            return m.end()
    return at


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, own begin, end) of each piece: the piece is text[start:end], of which [start, own begin) is overlap."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    own = limit - overlap
    # the first piece has no overlap and may be longer: as many leading spans as fit
    spans = _pack(text, 0, len(text), 0, own)
    if len(spans) > 1:
        first = _pack(text, 0, len(text), 0, limit)[0]
        rest = _pack(text, first[1], len(text), 0, own) if first[1] < len(text) else []
        if 1 + len(rest) <= len(spans):
            spans = [first, *rest]
    out = []
    for begin, end in spans:
        start = _overlap_start(text, begin, out[-1][0], overlap) if out else begin
        out.append((start, begin, end))
    return out


def _page(text: str, begin: int, first, last):
    if first is None:
        return None
    feeds = text.count("\f", 0, begin)
    if "\f" in text:
        return first + feeds if last is None else max(first, min(last, first + feeds))
    if last is None or last <= first:
        return first
    return first + min(last - first, (last - first + 1) * begin // max(1, len(text)))


SCHEMA = "chunk_id bigint, paper_id string, section_title string, page_start bigint, ord bigint, piece bigint, own_start bigint, text string"


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, whole: bool = False) -> DataFrame:
    """Pieces of the oversized chunks, to be read in the order (paper_id, ord, chunk_id, piece).

    own_start: where in `text` the part begins that the piece before does not have.
    """
    rows = chunks.filter(F.length("text") > (-1 if whole else limit))
    data = F.struct("indexed_at", "paper_id", "section_title", "page_start", "page_end", "ord", "text")
    latest = rows.groupBy("chunk_id").agg(F.max(data).alias("c")).select("chunk_id", *[f"c.{c}" for c in ("paper_id", "section_title", "page_start", "page_end", "ord", "text")])

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for chunk, paper, title, first, last, ord_, text in zip(*[c.to_pylist() for c in batch.columns]):
                for k, (start, begin, end) in enumerate(split(text, limit, overlap)):
                    for column, value in zip(out, (chunk, paper, title, _page(text, begin, first, last), ord_, k, begin - start, text[start:end])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], names=_NAMES)

    return latest.mapInArrow(run, SCHEMA)


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]
