"""Problem 8: pages of stuffed keywords, links or product tags.

A page is cut into units at line ends and sentence ends.  A unit with clause structure (long enough, with several
different function words) is prose and never counts as spam.  Function words are those listed for five languages and
those that the page itself uses as such: very short words that stand in several units between ever other words.  What is
left is measured:

* links: addresses, anchors and titled links;
* tags and product lines: hash tags, tag and breadcrumb lines, lines of article numbers and prices;
* hollow phrases: short units that say the same words twice;
* repetition: over the letters of the remaining units, case, spacing, invisible characters and digit look-alikes
  folded away.  A character counts as covered if it lies in a repeated maximal substring, that is in a state of the page's
  suffix automaton, with at least `OCCURRENCES` end positions and `LENGTH` letters (Han characters count twice).  Every
  stretch of such a substring is repeated as often, so the states need to be told apart by their last `LENGTH` letters only:
  they are read from the ranks of the page's suffixes, doubled up to that length, in a few flat arrays.

A page is spam if more than half of its characters are counted.  An entry of a list of literature is honest however
uniform it is, unless its words are those of most other entries.

Results by case: null, empty and blank texts have share 0; repeated rows are judged each; an empty table gives no rows;
very long texts are read whole; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OCCURRENCES, LENGTH, SHARE = 3, 8, 0.5
PROSE_WORDS, PROSE_FUNCTION, PROSE_HAN = 10, 3, 12
#: A page's own function words stand between so many different words; a unit with them has so large a share of different words.
OWN_PLACES, PROSE_VARIED = 4, 0.8

# Function words of the languages of the corpus, plainly listed.
FUNCTION_WORDS = frozenset(
    """
    a an the and or but nor if of to in on at by for with from as is are was were be been it its this that these those which
    who whose while when than not into over under between our we they their there then both either neither whether yet although because
    der die das des dem den ein eine einer einem einen und oder aber nicht mit von zu im in auf für bei nach aus ist sind wird wurde sich
    jede jeder dort nur ob lässt während sofern obwohl dabei unter als
    le la les un une des du de et ou mais que qui ne pas sur dans par pour avec est sont on si bien selon toujours lorsque entre se au aux
    el los las una del y o pero no en con por para es son se lo aunque según siempre cuando sigue siendo cerca qué solo al su
    """.split()
)
FUNCTION_HAN = frozenset("的了与在是并则也若从对其这而但由因为和或被把所及使")

_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
_LINE = re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029]+")
_UNIT = re.compile(r"(?<=[.!?…])[\"')\]”’]*[^\S\n]+|(?<=[。!?])")
_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile(r"[一-鿿]")
_LINK = re.compile(
    r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|ftp://|www\.)[^\s<>\"]+|(?:[\w-]+\.)+[a-z]{2,12}/[^\s<>\"]*|(?<![\w./@-])(?:[a-z0-9][a-z0-9-]{2,}\.)+[a-z]{2,18}(?![\w.@-]|\()",
    re.S | re.I,
)
_LINK_SIGN = re.compile(r"\w\.\w|\]\(|<a\s|://", re.I)
_REFERENCE = re.compile(r"\b(?:19|20)\d\d\b.*\b(?:pp?|S)\.\s?\d+")
_HASH = re.compile(r"(?<![\w/])#[^\s#]+")
_TAGS = re.compile(r"(?i)\btags?\s*:|\s[»>›]\s|\(\d+\)(?:\s\s|$)")
_PRODUCT = re.compile(r"(?i)\bSKU\b\W*\w|\b(?:EAN|ISBN|Art\.?-?Nr|Item No)\b\W*\d|[€$£¥]\s?\d|\d\s?(?:€|EUR|USD)\b")
_LOOKALIKE = str.maketrans("0134578@$!", "oleastbasi")


def is_prose(unit: str, own: frozenset = frozenset()) -> bool:
    """Whether a unit has clause structure. own: function words of the page besides the listed ones."""
    words = [w.strip(".,;:!?()[]“”\"'") for w in unit.lower().split()]
    if len(words) >= PROSE_WORDS:
        used = FUNCTION_WORDS.intersection(words)
        if len(used) >= PROSE_FUNCTION:
            return True
        if own and len(used | own.intersection(words)) >= PROSE_FUNCTION and len(set(words)) >= PROSE_VARIED * len(words):
            return True
    if _HAN.search(unit):
        return len(_HAN.findall(unit)) >= PROSE_HAN and len(FUNCTION_HAN.intersection(unit)) >= 2
    return False


def own_function_words(units: list[str]) -> frozenset:
    """Words of at most three letters that stand in several long units of a page, each time between other words."""
    before: dict[str, set] = {}
    after: dict[str, set] = {}
    for unit in units:
        words = unit.split()
        if len(words) >= PROSE_WORDS:
            for x, w, y in zip(words, words[1:], words[2:]):
                if len(w) <= 3 and w.isalpha() and w.islower() and w.isascii() | (w[0] < "\u0530"):
                    before.setdefault(w, set()).add(x)
                    after.setdefault(w, set()).add(y)
    return frozenset(w for w, x in before.items() if len(x) >= OWN_PLACES and len(after[w]) >= OWN_PLACES)


def uniform_entries(entries: list[str]) -> set[int]:
    """Which entries of a list of literature have no words of their own: those with under three that not most others have."""
    words = [set(w for w in _WORD.findall(e.lower()) if len(w) > 2 and not w.isdigit()) for e in entries]
    places = Counter(w for ws in words for w in ws)
    most = max(2, len(entries) // 3)
    return {i for i, ws in enumerate(words) if sum(places[w] <= most for w in ws) < 3}


def hollow(unit: str) -> bool:
    """Whether a short unit says the same words twice, as in `the X is the X`."""
    words = _WORD.findall(unit.lower())
    pairs = list(zip(words, words[1:]))
    return 4 <= len(words) <= 16 and len(set(pairs)) < len(pairs)


def folded(text: str) -> str:
    """The letters of a text with spelling tricks undone."""
    words = _WORD.findall(unicodedata.normalize("NFKC", text).lower())
    return "".join([w if w.isalpha() else "" if w.isdigit() else w.translate(_LOOKALIKE) for w in words])


def covered(s: str, occurrences: int = OCCURRENCES, length: int = LENGTH) -> int:
    """Characters of s inside a substring of at least `length` weight that occurs at least `occurrences` times.

    The shortest stretch of enough weight from each place is named by the ranks of its first and last 2^k letters, 2^k
    the largest power inside it; places of one name are the occurrences of one stretch.
    """
    codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    n = len(codes)
    weight = np.concatenate([[0], np.cumsum(1 + ((codes >= 0x4E00) & (codes <= 0x9FFF)))])
    ends = np.searchsorted(weight, weight[:-1] + length)
    starts = np.flatnonzero(ends <= n)
    if len(starts) < occurrences:
        return 0
    sizes = ends[starts] - starts
    edge = np.zeros(n + 1, np.int32)
    rank, span = codes.astype(np.uint64), 1
    while True:
        mine = sizes < 2 * span
        for size in np.unique(sizes[mine]).tolist():
            at = starts[mine & (sizes == size)]
            _, which, times = np.unique((rank[at] << np.uint64(32)) | rank[at + (size - span)], return_inverse=True, return_counts=True)
            found = at[times[which] >= occurrences]
            np.add.at(edge, found, 1)
            np.add.at(edge, found + size, -1)
        starts, sizes = starts[~mine], sizes[~mine]
        if not len(starts):
            return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))
        # ranks of twice as many letters
        rank = np.unique((rank[: n - 2 * span + 1] << np.uint64(32)) | rank[span : n - span + 1], return_inverse=True)[1].astype(np.uint64)
        span *= 2


def share(text: str | None) -> float:
    """The share of a page's characters that is stuffed keywords, links, tags or product lines."""
    if not text or text.isspace():
        return 0.0
    text = _INVISIBLE.sub("", text)
    whole = len(text) - text.count(" ")
    if not whole:
        return 0.0
    linked = "." in text or "](" in text
    lines = _LINE.split(text)
    entries = [i for i, line in enumerate(lines) if linked and _REFERENCE.search(line)]
    if entries:
        uniform = uniform_entries([lines[i] for i in entries])
        honest = {i for k, i in enumerate(entries) if k not in uniform}
        lines = [line for i, line in enumerate(lines) if i not in honest]
    units = [unit for line in lines for unit in _UNIT.split(line) if unit and not unit.isspace()]
    unlinked = [(unit, _LINK.sub(" ", unit) if linked and _LINK_SIGN.search(unit) else unit) for unit in units]
    outside = [(unit, left) for unit, left in unlinked if not is_prose(left)]
    if any(left.count(" ") >= PROSE_WORDS - 1 for _, left in outside):
        own = own_function_words(units)
        if own:
            outside = [(unit, left) for unit, left in outside if not is_prose(left, own)]
    counted, rest = 0, []
    for unit, left in outside:
        n = len(unit) - unit.count(" ")
        if left != unit:
            # a titled link is one whole; a longer remark beside a link is not
            if len(_WORD.findall(left)) < PROSE_WORDS or "<a" in unit:
                counted += n
                continue
            counted += n - (len(left) - left.count(" "))
        hashes = sum(map(len, _HASH.findall(left)))
        if hollow(left) or _PRODUCT.search(left) or 2 * hashes > n or (_TAGS.search(left) and len(_WORD.findall(left)) > 2):
            counted += len(left) - left.count(" ")
            continue
        rest.append(left)
    letters = folded("\n".join(rest))
    if letters:
        n = sum(len(u) - u.count(" ") for u in rest)
        counted += n * covered(letters) / len(letters)
    return counted / whole


def shares(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `share` of every page."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([share(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["key", "share"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, share double").withColumnRenamed("key", key)


def stuffed(docs: DataFrame, key: str = "doc_id", text: str = "text", over: float = SHARE) -> DataFrame:
    return shares(docs, key, text).filter(F.col("share") > over).select(key)
