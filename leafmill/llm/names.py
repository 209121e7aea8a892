"""Problem 1: variant spellings of names.

Every spelling is read into a signature: the initial of its (formal) given name and its surname without particles, titles,
marks, case and diacritics; for a group, its kind and its own name.  Which of two words is the surname follows from
their use in all names, above all in those with a comma.  An initial with a surname never fits two persons, so equal signatures are one
entity.

Names with typing errors are found by suffix blocking: the suffixes of a surname, read forwards and backwards, from just under
half of its letters on, are indexed together with the initial (a name with one error keeps one of them); the suffixes of the
given name are indexed together with the surname, where the error is in the initial.  A suffix of more than `COMMON` names is
refined by what is left of the name beside the suffix with up to one letter deleted, which parts no pair, so that no block is
left out.  Two errors in a long surname may touch all its suffixes; such pairs meet by two deleted letters.  Pairs are
compared by the ratio of their longest common subsequence and an edit distance.

A spelling is an error of a more frequent one: each name goes to its most frequent neighbour that has no more frequent
one itself, so a chain of near names does not become one entity.  Two names that both occur `ATTESTED` times and neither
`OUTNUMBERED` times as often as the other are two names, however near they are.

Results by case: null and blank names and null or empty lists are no spellings; repeated spellings count once; a name
without a given name links only to spellings of equal letters; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

RATIO = 0.8
#: Names of one suffix and initial up to which they are compared directly.
COMMON = 200
#: Occurrences from which a name is no typing error, unless another one is so many times as frequent.
ATTESTED, OUTNUMBERED = 5, 1.5
#: Spellings of one entity that are paired in one task.
PIECE = 1000

# Short forms whose first letter differs from the formal name's, plainly listed.
FORMAL = dict(
    pair.split(":")
    for pair in """
    pepe:jose chepe:jose vanni:giovanni nanni:giovanni gianni:giovanni hans:johannes jan:johannes beppe:giuseppe peppe:giuseppe fritz:friedrich fred:frederick
    rick:frederick katya:ekaterina katja:ekaterina misha:mikhail mischa:mikhail paco:francisco pancho:francisco curro:francisco becky:rebecca becca:rebecca trish:patricia tricia:patricia
    liz:elizabeth beth:elizabeth betty:elizabeth lisa:elizabeth bess:elizabeth libby:elizabeth bill:william billy:william ted:theodore ned:edward teddy:theodore memo:guillermo
    kostya:konstantin nastya:anastasia stasia:anastasia vova:vladimir volodya:vladimir sasha:alexander sascha:alexander xander:alexander larry:lawrence lars:lars chuck:charles
    bob:robert bobby:robert dick:richard hank:henry harry:henry jack:john kathy:katherine kate:katherine kitty:katherine peggy:margaret meg:margaret greta:margaret
    tony:antonio toni:antonio toño:antonio tonio:antonio mina:wilhelmina minna:wilhelmina helma:wilhelmina billie:wilhelmina willa:wilhelmina dima:dmitri mitya:dmitri vicky:victoria tori:victoria
    gail:abigail bella:isabella nardo:leonardo etta:henrietta hettie:henrietta hetty:henrietta rafi:raphael zuzka:zuzana lupe:guadalupe nacho:ignacio
    topher:christopher kit:christopher drew:andrew tess:theresa tina:christina gina:regina sandy:alexandra sander:alexander lexi:alexandra
    nell:eleanor nora:eleanor ella:gabriella molly:mary polly:mary sally:sarah sadie:sarah nan:anne nancy:anne ina:katharina trine:katharina lotte:charlotte lina:carolina
    heinz:heinrich harro:harald jochen:joachim achim:joachim klaus:nikolaus niko:nikolaus claus:nikolaus basti:sebastian bastian:sebastian tom:thomas resi:theresia sepp:josef uli:ulrich
    zhenya:yevgenia jenya:yevgenia liam:william stacy:anastasia stacey:anastasia hias:matthias hiasl:matthias
    quique:enrique kike:enrique chuy:jesus lalo:eduardo beto:alberto neto:ernesto goyo:gregorio tito:ernesto yago:santiago
    """.split()
)
PARTICLES = frozenset("van von der den de del della di da dos du la le les al el bin ibn ter ten zu zum zur und af av".split())
TITLES = frozenset("dr prof professor mr mrs ms sir dipl ing phd msc bsc md mag".split())
SUFFIXES = frozenset("jr sr ii iii iv phd md".split())
#: Words of the names of groups, and what their short forms stand for.
GROUP = {
    "collaboration": "collaboration", "collab": "collaboration", "institute": "institute", "institut": "institute", "inst": "institute", "university": "university", "univ": "university", "universitat": "university",
    "u": "university", "library": "library", "libr": "library", "lib": "library", "group": "group", "grp": "group", "document": "document", "docu": "document", "doc": "document", "studies": "studies", "stud": "studies",
    "archive": "archive", "arch": "archive", "technology": "technology", "tech": "technology", "applied": "applied", "appl": "applied", "semantics": "semantics", "sem": "semantics", "semant": "semantics",
    "center": "center", "centre": "center", "ctr": "center", "laboratory": "laboratory", "lab": "laboratory", "consortium": "consortium", "cons": "consortium", "team": "team", "project": "project", "proj": "project",
    "department": "department", "dept": "department", "school": "school", "college": "college", "society": "society", "soc": "society", "network": "network", "research": "research", "res": "research", "statistical": "statistical", "stat": "statistical", "statistics": "statistical", "reading": "reading", "read": "reading", "corporation": "corporation", "corp": "corporation", "company": "company", "experiment": "experiment", "foundation": "foundation", "association": "association", "assoc": "association", "committee": "committee", "agency": "agency", "council": "council", "academy": "academy", "acad": "academy", "national": "national", "natl": "national", "international": "international", "intl": "international", "science": "science", "sci": "science", "sciences": "science", "computing": "computing", "comp": "computing",
}
_FILL = frozenset("of the for and in at fur".split())
_HEADS = frozenset("collaboration institute university group center laboratory consortium team project department school college society network corporation company experiment foundation association committee agency council academy".split())
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "’": "", "'": "", "ʼ": "", "`": "", "´": "", "‘": ""})
_MARKS = re.compile(r"[*†‡§¶#°^]+|\((?:ed|eds|hrsg)\.?\)|(?<=\D)[\d,;\s]*\d\s*$", re.I)


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.casefold().translate(_LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c))


def near(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, up to 2 (3: more)."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    before2, before = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before2[j - 2] + 1)
            row.append(d)
        before2, before = before, row
    return min(3, before[-1])


def lcs_ratio(a: str, b: str) -> float:
    """Twice the length of the longest common subsequence over both lengths."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            row[j] = left + 1 if x == y else max(up, row[j - 1])
            left = up
    return 2 * row[-1] / (len(a) + len(b))


def _group_word(token: str) -> str | None:
    if token in GROUP:
        return GROUP[token]
    if len(token) >= 6:
        for word in GROUP:
            if len(word) >= 5 and token[0] == word[0] and near(token, word) == 1:
                return GROUP[word]
    return None


def group_signature(tokens: list[str]) -> tuple[str, str] | None:
    """(kind, own name) of a group; None for a person."""
    words = [(t, _group_word(t)) for t in tokens if t not in _FILL]
    kinds = [w for _, w in words if w]
    if not any(k in _HEADS for k in kinds) or (len(kinds) == 1 and kinds[0] == "university" and "u" in tokens and len(tokens) <= 2):
        return None
    own = "".join(t for t, w in words if not w and len(t) > 1)
    return ("#" + " ".join(sorted(set(kinds))), own) if own else None


def parse(raw: str) -> dict | None:
    """What a spelling says by itself: a group's signature, or a person's words and their order if that is plain."""
    text = unicodedata.normalize("NFKC", raw)
    text = re.sub(r"[‐‑‒–—−]", "-", text)
    text = _MARKS.sub(" ", text)
    text = re.sub(r"(?<=[^\W\d_A-Z])(?=(?:Collab|Institut|Universit|Library|Group|Consortium)[a-z]*)", " ", text)
    plain = fold(text)
    words = re.findall(r"[^\W\d_]+", plain)
    group = group_signature(words)
    if group:
        return {"initial": group[0], "surname": group[1], "given": ""}
    comma = [p for p in (re.findall(r"[^\W\d_]+", x) for x in plain.split(",")) if p and not all(w in SUFFIXES or w in TITLES for w in p)]
    if len(comma) > 1:
        surname, given = comma[0], [w for w in comma[1] if w not in SUFFIXES]
        surname = [w for w in surname if w not in PARTICLES and w not in TITLES] or surname
        return {"initial": "", "surname": surname[-1], "given": given[0] if given else "", "comma": True}
    # a hyphen joins the parts of one name; an article before it is none
    joined = re.sub(r"\b(?:al|el)-+(?=\w)", "", re.sub(r"-+", "-", text.split(",")[0] if comma else ""), flags=re.I)
    bare = [w for w in re.findall(r"(?:[^\W\d_]|['’ʼ-])+\.?", joined) if re.search(r"[^\W\d_]", w)]
    words = [re.sub(r"[^\w]", "", fold(w)) for w in bare]
    while len(words) > 1 and words[0] in TITLES:
        words, bare = words[1:], bare[1:]
    while len(words) > 1 and words[-1] in SUFFIXES and (len(words) > 2 or not bare[-1].isupper()):
        words, bare = words[:-1], bare[:-1]
    if not words:
        return None
    if len(words) == 1:
        return {"initial": "", "surname": words[0], "given": ""}
    last = bare[-1] if bare else ""
    if len(words[-1]) <= 3 and last.replace("-", "").isupper() and not "".join(bare[:-1]).isupper():
        names = [w for w in words[:-1] if w not in PARTICLES] or words[:-1]
        return {"initial": "", "surname": names[-1], "given": words[-1]}
    if words[0] in PARTICLES:
        names = [w for w in words if w not in PARTICLES]
        if len(names) > 1:
            # surname first: all after it is given
            return {"initial": "", "surname": names[0], "given": names[1]}
    names = [w for w in words if w not in PARTICLES] or words
    if len(names) == 1:
        return {"initial": "", "surname": names[0], "given": ""}
    sure = any(w in PARTICLES for w in words[1:-1]) or len(words[0]) == 1
    return {"initial": "", "surname": names[-1], "given": names[0], "open": not sure, "other_given": names[1] if len(names) == 2 else names[-1]}


def spellings(papers: DataFrame, column: str = "authors") -> DataFrame:
    return papers.select(F.explode(column).alias("name")).filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def signatures(names: DataFrame) -> DataFrame:
    """name, n, initial, surname, given of each spelling."""

    def read(batches):
        for batch in batches:
            rows = []
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = parse(name)
                if p and p["surname"]:
                    rows.append((name, n, p["initial"], p["surname"], p["given"], p.get("comma", False), p.get("open", False)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_()))], names=cols)

    cols = ["name", "n", "initial", "surname", "given", "comma", "open"]
    read_ = written(names.select("name", "n").mapInArrow(read, "name string, n bigint, initial string, surname string, given string, comma boolean, open boolean"), "names")
    # how often a word is used as a given name and as a surname; where a comma tells it counts twice
    formal = F.create_map(*[F.lit(x) for pair in FORMAL.items() for x in pair])
    read_ = read_.withColumn("fg_word", F.coalesce(F.try_element_at(formal, F.col("given")), "given")).withColumn("ls_word", F.coalesce(F.try_element_at(formal, F.col("surname")), "surname"))
    weight = F.when(F.col("comma"), 2).otherwise(1)
    uses = F.array(F.struct(F.col("fg_word").alias("word"), weight.alias("g"), F.lit(0).alias("s")), F.struct(F.col("ls_word").alias("word"), F.lit(0).alias("g"), weight.alias("s")))
    told = read_.filter("initial = '' and length(given) > 1").select(F.explode(uses).alias("w")).select("w.*").groupBy("word").agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
    first = told.select(F.col("word").alias("fg_word"), F.col("g").alias("fg"), F.col("s").alias("fs"))
    last = told.select(F.col("word").alias("ls_word"), F.col("g").alias("lg"), F.col("s").alias("ls"))
    placed = read_.join(first, "fg_word", "left").join(last, "ls_word", "left").na.fill(0, ["fg", "fs", "lg", "ls"])
    # the last word is mostly a given name, and the first is not so any more than the last
    swap = F.col("open") & (F.length("given") > 1) & (F.col("lg") > F.col("ls")) & (F.col("fg") * F.col("ls") < F.col("fs") * F.col("lg"))
    surname, given = F.when(swap, F.col("given")).otherwise(F.col("surname")), F.when(swap, F.col("surname")).otherwise(F.col("given"))
    out = placed.select("name", "n", F.col("initial").alias("kind"), surname.alias("surname"), F.coalesce(F.try_element_at(formal, given), given).alias("given"))
    return out.select("name", "n", F.when(F.col("kind") != "", F.col("kind")).otherwise(F.substring("given", 1, 1)).alias("initial"), "surname", "given")


def _cut(word: str, times: int) -> set[str]:
    """The word with up to so many letters deleted."""
    found = now = {word}
    for _ in range(times):
        now = {w[:k] + w[k + 1 :] for w in now for k in range(len(w))}
        found = found | now
    return found


def _suffixes(word: str) -> list[tuple[str, str, str]]:
    """(direction, suffix, rest) of a surname and of its letters backwards.

    One error, a swap of neighbours included, leaves at least (n - 2) / 2 letters, rounded up, before or after it, n being
    the shorter of both lengths.
    """
    out = []
    for way, w in ((">", word), ("<", word[::-1])):
        for size in sorted({max(1, (n - 1) // 2) for n in (len(w) - 1, len(w)) if n > 1}):
            out.append((way, w[len(w) - size :], w[: len(w) - size]))
    return out


def _arrow(rows: list, kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)


_TEXT, _NUMBER = pa.string(), pa.int64()


def _met_surnames(names: DataFrame) -> DataFrame:
    """initial, surname1, surname2 (in order) of all names that may be one with an error. names: initial, surname,
    given_length (of the longest given name: two errors are looked for only where given names can be compared)."""

    def index(batches):
        for batch in batches:
            out = [(f"{i}|{way}{end}", i, s, rest) for i, s in zip(*[c.to_pylist() for c in batch.columns]) if len(s) > 3 or i.startswith("#") for way, end, rest in _suffixes(s)]
            yield _arrow(out, (_TEXT,) * 4, ["block", "initial", "surname", "rest"])

    def refine(batches):
        for batch in batches:
            out = [(f"{b}|{c}", i, s) for b, i, s, rest in zip(*[c.to_pylist() for c in batch.columns]) for c in _cut(rest, 1)]
            yield _arrow(out, (_TEXT,) * 3, ["block", "initial", "surname"])

    def twice(batches):
        for batch in batches:
            out = [(f"{i}|{c}", i, s) for i, s in zip(*[c.to_pylist() for c in batch.columns]) for c in _cut(s, 2)]
            yield _arrow(out, (_TEXT,) * 3, ["block", "initial", "surname"])

    rows = written(names.select("initial", "surname").mapInArrow(index, "block string, initial string, surname string, rest string"), "suffixes")
    common = rows.groupBy("block").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > COMMON).select("block")
    three = "block string, initial string, surname string"
    few = rows.join(common, "block", "left_anti").select("block", "initial", "surname")
    many = rows.join(common, "block", "left_semi").mapInArrow(refine, three)
    group = F.col("initial").startswith("#")
    long = names.filter(F.length("surname") >= F.when(group, 9).otherwise(8)).filter(group | (F.col("given_length") > 2)).select("initial", "surname").mapInArrow(twice, three)
    blocks = written(few.unionByName(many).unionByName(long), "blocks")
    left, right = blocks.toDF("block", "initial", "surname1"), blocks.toDF("block", "initial2", "surname2").drop("initial2")
    return left.join(right, "block").filter("surname1 < surname2").select("initial", "surname1", "surname2").distinct()


def _key(initial, surname):
    return F.xxhash64(F.lit("name"), initial, surname)


def _typed(sigs: DataFrame) -> DataFrame:
    """a, b (keys) of all names that are alike and differ in initial or surname."""

    def one(batches):
        for batch in batches:
            rows = [r for r in zip(*[c.to_pylist() for c in batch.columns])]
            out = [(*r, alike((r[0], r[1], ""), (r[0], r[2], ""))) for r in rows]
            out = [r for r in out if r[3] or (near(r[1], r[2]) == 2 and not r[0].startswith("#"))]
            yield _arrow(out, (_TEXT, _TEXT, _TEXT, pa.bool_()), ["initial", "surname1", "surname2", "sure"])

    def givens(batches):
        for batch in batches:
            out = [(i, s, g, g[k:]) for i, s, g in zip(*[c.to_pylist() for c in batch.columns]) for k in (0, 1, 2) if len(g) - k > 1]
            yield _arrow(out, (_TEXT,) * 4, ["initial", "surname", "given", "suffix"])

    def two(batches):
        for batch in batches:
            c = [x.to_pylist() for x in batch.columns]
            pairs = [((c[0][k], c[1][k], c[2][k]), (c[3][k], c[4][k], c[5][k])) for k in range(batch.num_rows)]
            rows = pa.array([k for k, (x, y) in enumerate(pairs) if alike(x, y) or alike(y, x)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(j).take(rows) for j in (0, 1, 3, 4)], names=["initial1", "surname1", "initial2", "surname2"])

    names = sigs.filter("initial <> ''").groupBy("initial", "surname").agg(F.max(F.length("given")).alias("given_length"))
    met = written(_met_surnames(names).mapInArrow(one, "initial string, surname1 string, surname2 string, sure boolean"), "surname-pairs")
    full = sigs.filter("initial <> '' and initial not like '#%' and length(given) > 2").select("initial", "surname", "given").distinct()
    # two errors in the surname: under given names that are near
    left, right = full.toDF("initial", "surname1", "given1"), full.toDF("initial", "surname2", "given2")
    six = ["initial1", "surname1", "given1", "initial2", "surname2", "given2"]
    double = met.filter("not sure").join(left, ["initial", "surname1"]).join(right, ["initial", "surname2"])
    double = double.filter(F.levenshtein("given1", "given2", 2).between(0, 2)).select(F.col("initial").alias("initial1"), "surname1", "given1", F.col("initial").alias("initial2"), "surname2", "given2")
    # an error in the initial: the rest of the given name is a suffix under the same surname
    ends = written(full.mapInArrow(givens, "initial string, surname string, given string, suffix string"), "given-suffixes")
    l, r = ends.toDF("initial1", "surname", "given1", "suffix"), ends.toDF("initial2", "surname", "given2", "suffix")
    other = l.join(r, ["surname", "suffix"]).filter("initial1 < initial2").select("initial1", F.col("surname").alias("surname1"), "given1", "initial2", F.col("surname").alias("surname2"), "given2").distinct()
    four = "initial1 string, surname1 string, initial2 string, surname2 string"
    found = double.unionByName(other).select(six).mapInArrow(two, four)
    sure = met.filter("sure").select(F.col("initial").alias("initial1"), "surname1", F.col("initial").alias("initial2"), "surname2")
    return sure.unionByName(found).select(_key("initial1", "surname1").alias("a"), _key("initial2", "surname2").alias("b")).distinct()


def alike(a: tuple[str, str, str], b: tuple[str, str, str]) -> bool:
    """Whether two different signatures (initial, surname, given) are one name with typing errors."""
    (i, s, g), (j, t, h) = a, b
    if i.startswith("#") or j.startswith("#"):
        return i == j and near(s, t) <= (1 if min(len(s), len(t)) < 9 else 2) and lcs_ratio(s, t) >= RATIO
    if not i or not j:
        return False
    if i == j:
        d = near(s, t)
        if d == 0:
            return True
        if d == 1 and min(len(s), len(t)) >= 4:
            return lcs_ratio(s, t) >= RATIO
        # two errors in a long surname only under the same full given name
        return d == 2 and min(len(s), len(t)) >= 8 and len(g) > 2 and near(g, h) <= 1 and lcs_ratio(s, t) >= RATIO
    # another initial: the given name itself is mistyped
    return s == t and len(g) > 2 and len(h) > 2 and near(g, h) <= 1 and lcs_ratio(g, h) >= RATIO


def _centred(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, entity of each name that goes to another one. keys: key, surname, n. pairs: a, b.

    The direction is from the less to the more frequent name (the larger key at a tie). A name without a more frequent
    neighbour is a centre; another one goes to its most frequent neighbour that is a centre or, without any, with its
    most frequent neighbour to that one's centre, if it is within two errors of it.
    """
    pairs = pairs.join(keys.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("surname").alias("sa")), "a").join(keys.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("surname").alias("sb")), "b")
    pairs = pairs.filter(~((F.least("na", "nb") >= ATTESTED) & (F.greatest("na", "nb") < OUTNUMBERED * F.least("na", "nb"))))
    up = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") > F.col("a")))
    x, y = F.struct(F.col("a").alias("key"), F.col("na").alias("n"), F.col("sa").alias("s")), F.struct(F.col("b").alias("key"), F.col("nb").alias("n"), F.col("sb").alias("s"))
    edges = written(pairs.select(F.when(up, x).otherwise(y).alias("low"), F.when(up, y).otherwise(x).alias("high")).select(F.col("low.key").alias("key"), F.col("low.s").alias("surname"), F.col("high.key").alias("to"), F.col("high.n").alias("n"), F.col("high.s").alias("center")), "name-edges")
    lower = edges.select(F.col("key").alias("to")).distinct()
    best = lambda e: e.groupBy("key").agg(F.max_by(F.struct("to", "center", "surname"), F.struct("n", "to")).alias("e")).select("key", "e.*")
    direct = written(best(edges.join(lower, "to", "left_anti")), "centred")
    rest = best(edges.join(direct.select("key"), "key", "left_anti"))
    through = rest.join(direct.select(F.col("key").alias("to"), F.col("to").alias("top"), F.col("center").alias("top_name")), "to").filter(F.levenshtein("surname", "top_name", 2).between(0, 2))
    return direct.select("key", F.col("to").alias("entity")).unionByName(through.select("key", F.col("top").alias("entity")))


def entities(papers: DataFrame, column: str = "authors") -> DataFrame:
    """name, n, entity (a number) of every spelling."""
    read = signatures(spellings(papers, column))
    # a name is an initial with a surname; without an initial it links to spellings of equal letters only
    key = F.when(F.col("initial") != "", _key("initial", "surname")).otherwise(F.xxhash64("initial", "surname", "given"))
    read = written(read.withColumn("key", key), "signatures")
    keys = written(read.filter("initial <> ''").groupBy("key", "surname").agg(F.sum("n").alias("n")), "name-keys")
    found = _centred(keys, _typed(read.select("initial", "surname", "given").distinct()))
    return read.join(found, "key", "left").select("name", "n", F.coalesce("entity", "key").alias("entity"))


def linked(named: DataFrame) -> DataFrame:
    """Every pair (name_a < name_b by code points) of spellings of one entity. An entity of very many spellings is
    paired in pieces, every piece with all its spellings."""
    named = written(named.select("entity", "name"), "entities")
    sizes = named.groupBy("entity").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("entity", F.ceil(F.col("size") / PIECE).cast("int").alias("pieces"))
    named = named.join(sizes, "entity")
    left = named.select("entity", F.col("name").alias("name_a"), F.pmod(F.xxhash64("name"), F.col("pieces")).cast("int").alias("piece"))
    right = named.select("entity", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    return left.join(right, ["entity", "piece"]).filter("name_a < name_b").select("name_a", "name_b")
