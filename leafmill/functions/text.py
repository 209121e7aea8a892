"""String, number, date and hash functions as column expressions (STR, NUM, DT, HSH, FLT7-FLT9)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns of the formats that are read.
EVIDENCE_REF = r"^\[([0-9a-f]{64}):page\[([1-9][0-9]*)\]\]$"
EVIDENCE_ANY = r"\[[A-Za-z0-9_-]{3,64}:[A-Za-z_][A-Za-z0-9_.\[\]-]*\]"
ARXIV = r"(?i)^\s*(?:arXiv:)?([a-z\-]+(?:\.[A-Z]{2})?/\d{7}|\d{4}\.\d{4,5})(?:v\d+)?\s*$"
AUTH = r"(?i)\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]+"
SECRET = r"(?i)\b(api[_-]?key|access[_-]?token|refresh[_-]?token|password|passwd|secret|authorization|cookie)(\s*[:=]\s*)([^\s,;]+)"
SK_KEY = r"\bsk-[A-Za-z0-9_-]{8,}\b"
SIGNATURE_MASK = r"0[xX][0-9a-fA-F]+|\d+\.\d+|\d+(?!\\?\"[,}]|$)"
PROSE = r"[㐀-鿿]|[A-Za-z]{2,}"
GARBLE = r"[�-\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F]"
# Names of fields that hold secrets.
SENSITIVE = ("authorization", "cookie", "passwd", "password", "proxy_authorization", "secret", "set_cookie", "token")
LINE_END = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]"


def has_prose(c: Column) -> Column:
    return c.rlike(PROSE)


def garbled(c: Column) -> Column:
    return c.rlike(GARBLE)


def garble_count(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, GARBLE, ""))


def lines(c: Column) -> Column:
    """Lines of a text by every line end that exists, without an empty last one."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


@F.pandas_udf(T.StringType())
def case_folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(t.split()).casefold())


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """NFKC of the case-folded text with white space collapsed (STR1); there is no built-in for either."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t.casefold()).split()))


def search_key(c: Column) -> Column:
    """folded(), inside the JVM for ASCII texts."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))).otherwise(folded(c))


def query_fingerprint(c: Column) -> Column:
    """Hash of a query with white space collapsed and then case folded, other forms of a character kept apart (STR2)."""
    plain = F.when(c.rlike(r"^[\x21-\x7E ]*$"), F.trim(F.regexp_replace(F.lower(c), " +", " "))).otherwise(case_folded(c))
    return F.sha2(plain, 256)


def plain_key(c: Column) -> Column:
    """Lower case without outer white space (STR3)."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def arxiv_id(c: Column) -> Column:
    """The bare identifier, null if there is none (STR4)."""
    return F.nullif(F.regexp_extract(c, ARXIV, 1), F.lit(""))


def redacted(c: Column) -> Column:
    """Credentials, then key-value secrets, then keys, blacked out (STR5)."""
    c = F.regexp_replace(c, AUTH, "$1 [REDACTED]")
    c = F.regexp_replace(c, SECRET, "$1$2[REDACTED]")
    return F.regexp_replace(c, SK_KEY, "[REDACTED]")


def sensitive_key(c: Column) -> Column:
    """Whether a field name holds a secret (FLT7)."""
    name = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    return name.isin(*SENSITIVE) | name.rlike("(_api_key|_password|_secret|_token)$")


def bounded(c: Column, n: int) -> Column:
    """At most n characters, with an ellipsis where text is missing (STR6)."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("…")))


@F.pandas_udf(T.StringType())
def _edges_decoded(parts: pd.Series) -> pd.Series:
    return parts.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def head_and_tail(c: Column, tokens: int, marker: str = "\n[... shortened ...]\n") -> Column:
    """First and last half of a byte budget of four bytes a token; broken characters at the cuts are dropped (STR7)."""
    budget = tokens * 4
    head = budget // 2
    raw = F.encode(c, "utf-8")
    size = F.octet_length(c)
    cut = F.concat(_edges_decoded(F.substring(raw, 1, head)), F.lit(marker), _edges_decoded(F.substring(raw, -(budget - head), budget - head)))
    return F.when(size <= budget, c).otherwise(cut)


def capped(c: Column, most: int, reserve: int = 500) -> Column:
    """A text, or a JSON envelope with the reason, its beginning, length and hash (STR8)."""
    reason = F.lit("tool output exceeded its application-defined context limit").alias("reason")
    head = F.substring(c, 1, max(most - reserve, 0)).alias("preview")
    envelope = F.struct(F.lit("truncated").alias("status"), reason, head, F.length(c).alias("original_length"), F.sha2(c, 256).alias("sha256"))
    return F.when(F.length(c) <= most, c).otherwise(F.to_json(envelope))


def visible_controls(c: Column) -> Column:
    """Control characters as their pictures, line ends kept (STR9)."""
    codes = [i for i in range(32) if i not in (9, 10, 11, 12, 13, 28, 29, 30)]
    return F.translate(c, "".join(map(chr, codes)) + "\x7f", "".join(chr(0x2400 + i) for i in codes) + "␡")


def masked_signature(c: Column) -> Column:
    """Numbers masked, white space folded, first 512 characters (STR14)."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, SIGNATURE_MASK, "#"), r"\s+", " "), 1, 512)


def evidence_refs(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(EVIDENCE_ANY), F.lit(0)))


def bold_header(c: Column) -> Column:
    """The first bold phrase (STR18)."""
    return F.nullif(F.trim(F.regexp_extract(c, r"\*\*(.+?)\*\*", 1)), F.lit(""))


def json_object(c: Column) -> Column:
    """From the first opening to the last closing brace (STR19); null without both."""
    start, back = F.locate("{", c), F.locate("}", F.reverse(c))
    end = F.length(c) - back + 1
    return F.when((start > 0) & (back > 0) & (end > start), F.substring(c, start, end - start + 1))


def font_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[A-Z]{6}\+", "")), "[^a-z0-9]", "")


def labelled_number(c: Column, label: str) -> Column:
    """The number after a label at a line's begin, if it is at least 1 (STR23)."""
    n = F.regexp_extract(c, rf"(?m)^{label}:\s*(\d+)", 1).try_cast("bigint")
    return F.when(n >= 1, n)


def png_size(c: Column) -> Column:
    """(width, height) of PNG bytes, null for other bytes (STR24)."""
    number = lambda at: F.conv(F.hex(F.substring(c, at, 4)), 16, 10).cast("bigint")
    ok = (F.hex(F.substring(c, 1, 8)) == "89504E470D0A1A0A") & (F.octet_length(c) >= 24)
    return F.when(ok, F.struct(number(17).alias("width"), number(21).alias("height")))


def bare_latex(c: Column) -> Column:
    """Without the outermost math delimiters; of the pairs that fit, the first of `$$`, `\\[`, `\\(` and `$` (STR25)."""
    t = F.trim(c)
    inner = lambda a, b: F.trim(F.substring(t, F.lit(a + 1), F.length(t) - a - b))
    out = t
    for a, b in (("$", "$"), ("\\(", "\\)"), ("\\[", "\\]"), ("$$", "$$")):  # the last one that fits is the outer `when`
        out = F.when(t.startswith(a) & t.endswith(b) & (F.length(t) >= len(a) + len(b)), inner(len(a), len(b))).otherwise(out)
    return out


def tail(c: Column, active: Column, n: int = 4000, notice: str = "… ") -> Column:
    """The end of a text behind a notice while it is still growing; else the text (STR26)."""
    return F.when(active & (F.length(c) > n), F.concat(F.lit(notice), F.substring(c, -n, n))).otherwise(c)


def token_estimate(c: Column, bytes_per_token: int = 3) -> Column:
    """At least one token for so many bytes (NUM1)."""
    return F.greatest(F.ceil(F.octet_length(c) / bytes_per_token), F.lit(1)).cast("bigint")


def used_fraction(used: Column, window: Column, baseline: int = 12_000) -> Column:
    """Share of a context in use beyond a baseline, from 0 to 1 (NUM2)."""
    return F.when(window <= baseline, F.lit(1.0)).otherwise(F.least(F.greatest((used - baseline) / (window - baseline), F.lit(0.0)), F.lit(1.0)))


def normalized(value: Column, origin: Column, size: Column) -> Column:
    """A coordinate as a share of the page, four decimals, inside 0 to 1 (NUM3)."""
    return F.least(F.greatest(F.bround((value - origin) / size, 4), F.lit(0.0)), F.lit(1.0))


def pixels(low: Column, high: Column, size: Column) -> Column:
    """Pixels of a share of a side, at least one (NUM8)."""
    return F.greatest(F.lit(1), (high * size).cast("int") - (low * size).cast("int"))


def exceeds(value: Column, golden: Column, factor: float = 1.5) -> Column:
    """Beyond the allowed factor; an equal value passes (NUM6)."""
    return value > golden * factor


def halved(found: Column, golden: Column) -> Column:
    """Fewer than half of the items of a non-empty golden list, by their numbers (NUM7)."""
    return (golden > 0) & (found < golden * 0.5)


def iso_instant(c: Column) -> Column:
    """An ISO timestamp with an offset as an instant; null without one (DT1)."""
    return F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))


def expired(at: Column, now: Column, days: int) -> Column:
    return at <= now - F.make_dt_interval(days=F.lit(days))


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd'T'HHmmss")


def canonical_sha(c: Column) -> Column:
    """Hash of a JSON value with sorted keys and no blanks (HSH2)."""
    return F.sha2(F.to_json(F.try_parse_json(c)), 256)


def bundle_sha(pairs: str) -> Column:
    """Hash over the sorted distinct values of a group, null for none (HSH4)."""
    all_ = F.array_sort(F.collect_set(pairs))
    return F.when(F.size(all_) > 0, F.sha2(F.to_json(all_), 256))


def context_limits(window: Column) -> Column:
    """Tokens to work with and tokens at which history is compacted, as whole percents of a window (NUM4)."""
    return F.struct(F.floor(window * 95 / 100).cast("bigint").alias("working"), F.floor(window * 90 / 100).cast("bigint").alias("trigger"))


def render_scale(width: Column, height: Column, base: int = 1800, most: int = 3600, least_width: float = 700.0, least_height: float = 180.0) -> Column:
    """Longest side in pixels at which a crop is wide and high enough to be read (NUM5)."""
    factor = F.greatest(F.lit(1.0), F.lit(least_width) / F.greatest(width, F.lit(1.0)), F.lit(least_height) / F.greatest(height, F.lit(1.0)))
    return F.least(F.floor(base * factor + 0.5), F.lit(most)).cast("bigint")


def iso_time(micros: Column) -> Column:
    """A modification time in microseconds as ISO text in UTC (DT3)."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def without_surrogates(c: Column) -> Column:
    """Text from bytes; what is no valid UTF-8, lone surrogates included, becomes the replacement character (STR11)."""
    return F.make_valid_utf8(c.cast("string"))


def skill_header(c: Column, name: Column) -> Column:
    """(version, description) of a document with such a header; null unless it declares each exactly once (STR21)."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    versions, descriptions = F.regexp_extract_all(t, F.lit(r"(?m)^version: *(.+)$"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"(?m)^description: *(.+)$"), F.lit(1))
    ok = t.startswith(F.concat(F.lit("---\nname: "), name, F.lit("\n"))) & (F.size(versions) == 1) & (F.size(descriptions) == 1)
    return F.when(ok, F.struct(versions[0].alias("version"), descriptions[0].alias("description")))


def values_after(c: Column, marker: str, prefix: str, end: str) -> Column:
    """The value on the first line with a prefix after each marker line (STR27)."""
    rows = F.transform(F.split(c, "\n"), lambda r: F.trim(r))
    one = F.aggregate(
        rows,
        F.struct(F.lit(False).alias("waiting"), F.array().cast("array<string>").alias("found")),
        lambda s, r: F.struct(
            F.when(r == marker, True).when(s["waiting"] & r.startswith(prefix), False).otherwise(s["waiting"]).alias("waiting"),
            F.when((r != marker) & s["waiting"] & r.startswith(prefix), F.concat(s["found"], F.array(F.substring_index(F.substring(r, len(prefix) + 1, 1 << 30), end, 1)))).otherwise(s["found"]).alias("found"),
        ),
    )
    return one["found"]


def page_lines(c: Column, page: Column, damaged: Column, note: str = "[formula text may be garbled]") -> Column:
    """A page as it is shown (STR10): a marker, a blank line, its lines; runs of damaged lines are wrapped and marked.

    damaged: an array of booleans, one for each line.
    """
    rows = F.arrays_zip(lines(visible_controls(c)).alias("t"), damaged.alias("d"))
    begin = F.concat(F.lit("[[damaged page="), page.cast("string"), F.lit("]]\n" + note + "\n"))
    n = F.size(rows)
    shown = F.transform(
        rows,
        lambda r, i: F.when(
            r["d"],
            F.concat(
                F.when((i == 0) | ~F.get(damaged, i - 1), begin).otherwise(""), F.lit("raw: "), r["t"],
                F.when((i == n - 1) | ~F.get(damaged, i + 1), F.lit("\n[[damaged end]]")).otherwise(""),
            ),
        ).otherwise(r["t"]),
    )
    whole = F.concat_ws("\n", F.concat(F.array(F.concat(F.lit("[[page:"), page.cast("string"), F.lit("]]")), F.lit("")), shown))
    return F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n"))
