"""State machines over text as Arrow UDFs (STR12, STR13, STR16, STR17, STR20, STR21, STR27)."""

from __future__ import annotations

import difflib
import re
import shlex

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shell_parts(command: str, most: int = 32) -> list[str]:
    """The commands of a shell line: cut at && || ; | and line ends outside of quotes, escapes and parentheses."""
    parts, now, quote, depth, i = [], "", "", 0, 0
    while i < len(command):
        c = command[i]
        if quote:
            now += c
            if c == "\\" and quote == '"' and i + 1 < len(command):
                i += 1
                now += command[i]
            elif c == quote:
                quote = ""
        elif c == "\\" and i + 1 < len(command):
            now += command[i : i + 2]
            i += 1
        elif c in "'\"":
            quote = c
            now += c
        elif c in "()":
            depth = max(0, depth + (1 if c == "(" else -1))
            now += c
        elif depth == 0 and c in ";|&\n" and (c != "&" or command[i : i + 2] == "&&"):
            parts.append(now.strip())
            now = ""
            if command[i : i + 2] in ("&&", "||"):
                i += 1
        else:
            now += c
        i += 1
    parts.append(now.strip())
    return [p for p in parts if p][:most]


def read_command(command: str) -> tuple[str, list[str]] | None:
    """The operation and arguments of `paper read|search ...`; None for other or unbalanced commands."""
    try:
        words = shlex.split(command)
    except ValueError:
        return None
    return (words[1], words[2:]) if len(words) > 1 and words[0] == "paper" and words[1] in ("read", "search") else None


def markdown_blocks(text: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) of the blocks: heading, fence, math, table, rule, quote, item, paragraph."""
    out: list[tuple[str, int, str]] = []
    lines, i, paragraph = text.splitlines(), 0, []

    def close():
        if paragraph:
            out.append(("paragraph", 0, " ".join(paragraph)))
            paragraph.clear()

    while i < len(lines):
        line = lines[i]
        s = line.strip()
        m = re.match(r"(#{1,6})\s+(.*?)\s*#*$", s)
        item = re.match(r"(\s*)(?:[-*+]|\d+[.)])\s+(.*)", line)
        fence = re.match(r"(```+|~~~+)", s)
        if fence or s == "$$":
            close()
            end = fence.group(1)[:3] if fence else "$$"
            body = []
            i += 1
            while i < len(lines) and not lines[i].strip().startswith(end):
                body.append(lines[i])
                i += 1
            out.append(("fence" if fence else "math", 0, "\n".join(body)))
        elif not s:
            close()
        elif m:
            close()
            out.append(("heading", len(m.group(1)), m.group(2)))
        elif re.fullmatch(r"(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,}", s):
            close()
            out.append(("rule", 0, ""))
        elif "|" in s and i + 1 < len(lines) and re.fullmatch(r"\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?", lines[i + 1].strip()):
            close()
            rows = [s]
            i += 2
            while i < len(lines) and "|" in lines[i]:
                rows.append(lines[i].strip())
                i += 1
            out.append(("table", len(rows) - 1, "\n".join(rows)))
            continue
        elif s.startswith(">"):
            close()
            out.append(("quote", 0, s.lstrip("> ")))
        elif item:
            close()
            out.append(("item", min(4, 1 + len(item.group(1).expandtabs(4)) // 2), item.group(2)))
        elif out and out[-1][0] in ("item", "quote") and not paragraph and i and lines[i - 1].strip():
            kind, level, before = out.pop()
            out.append((kind, level, f"{before} {s}"))
        else:
            paragraph.append(s)
        i += 1
    close()
    return out


def inline_math(text: str) -> list[tuple[str, str]]:
    """(kind, text) pieces of a line, kind text or math; escapes and code spans are text."""
    out: list[tuple[str, str]] = []
    pattern = re.compile(r"`[^`]*`|\\\$|\$(?!\s)((?:[^$\\]|\\.)+?)(?<!\s)\$|\\\((.+?)\\\)", re.S)
    at = 0
    for m in pattern.finditer(text):
        body = m.group(1) if m.group(1) is not None else m.group(2)
        if body is None:
            continue
        if m.start() > at:
            out.append(("text", text[at : m.start()]))
        out.append(("math", body))
        at = m.end()
    if at < len(text):
        out.append(("text", text[at:]))
    return out


def unified(before: str, after: str) -> str:
    return "\n".join(difflib.unified_diff((before or "").splitlines(), (after or "").splitlines(), "before", "after", lineterm=""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def shell_segments(commands: pd.Series) -> pd.Series:
    return commands.map(lambda c: None if c is None else shell_parts(c))


@F.pandas_udf(T.StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([None if a is None and b is None else unified(a, b) for a, b in zip(before, after)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())])))
def markdown(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [{"kind": k, "level": n, "text": x} for k, n, x in markdown_blocks(t)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])))
def math_pieces(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [{"kind": k, "text": x} for k, x in inline_math(t)])


@F.pandas_udf(T.StructType([T.StructField("operation", T.StringType()), T.StructField("arguments", T.ArrayType(T.StringType()))]))
def command(commands: pd.Series) -> pd.DataFrame:
    """Operation and arguments of a read or search command (STR13); null for other commands."""
    parsed = [None if c is None else read_command(c) for c in commands]
    return pd.DataFrame({"operation": [p and p[0] for p in parsed], "arguments": [p and p[1] for p in parsed]})
