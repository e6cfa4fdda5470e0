"""Rule files: a flat mapping of scalars and lists in YAML notation, read in tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.functions.text import normalize_tags
from vantage.operators.rules import RULE_SCHEMA, TERM_SCHEMA, rule_row
from vantage.session import materialize

# Escapes of a double-quoted scalar.
ESCAPES = {
    "0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"',
    "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029",
}
WIDTHS = {"x": 2, "u": 4, "U": 8}


def _folded(text: str) -> str:
    """Line breaks inside a scalar: one is a space, more are one break less."""
    return re.sub(r"[ \t]*\n(?:[ \t]*\n)*[ \t]*", lambda m: "\n" * (m.group().count("\n") - 1) or " ", text)


def _quoted(text: str) -> str:
    """A scalar in double or single quotes; nothing but a comment may follow it."""
    if text[0] == "'":
        m = re.fullmatch(r"'((?:[^']|'')*)'\s*(?:#.*)?", text, re.S)
        if not m:
            raise ValueError("open quote")
        return _folded(m.group(1)).replace("''", "'")
    m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"\s*(?:#.*)?', text, re.S)
    if not m:
        raise ValueError("open quote")
    out = []
    for part in re.split(r"(\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|\n[ \t]*|.))", m.group(1), flags=re.S):
        if part[:1] != "\\":
            out.append(_folded(part))
        elif part[1] in WIDTHS and len(part) > 2:
            out.append(chr(int(part[2:], 16)))
        elif part[1] != "\n":
            out.append(ESCAPES[part[1]])
    return "".join(out)


def _scalar(lines: list[str]) -> str | None:
    """A scalar on a line and the lines that go on with it."""
    head = lines[0].strip()
    if head[:1] in ("'", '"'):
        return _quoted("\n".join([head, *[line.strip(" \t") if not line.rstrip().endswith("\\") else line.lstrip(" \t") for line in lines[1:]]]).strip())
    if re.fullmatch(r"[|>][+-]?", head):
        body = lines[1:]
        while body and not body[-1].strip():
            body.pop()
        depth = min((len(x) - len(x.lstrip(" ")) for x in body if x.strip()), default=0)
        text = "\n".join(x[depth:] for x in body)
        return (text if head[0] == "|" else _folded(text)) + ("" if head.endswith("-") else "\n")
    if head[:1] in ("&", "*", "!", "{", "%", "@", "`"):
        raise ValueError("not a plain scalar")
    plain = [re.sub(r"(^|\s)#.*$", "", line).strip() for line in [head, *lines[1:]]]
    if any(re.search(r":(\s|$)", line) for line in plain):
        raise ValueError("mapping inside a scalar")
    text = _folded("\n".join(plain).strip())
    return None if text in ("", "~", "null", "Null", "NULL") else text


def read_record(text: str) -> dict | None:
    """The mapping of a rule file, scalars as text; None where it is not one."""
    record, blocks = {}, []
    for line in text.removeprefix("\ufeff").splitlines():
        if re.match(r"[A-Za-z_][\w-]*:(\s|$)", line):
            blocks.append([line])
        elif blocks and (line[:1] in (" ", "\t", "-", "") or blocks[-1][0].partition(":")[2].strip()[:1] in ('"', "'")) and line.strip() != "---":
            blocks[-1].append(line)
        elif line.strip() and not line.lstrip().startswith("#") and line.strip() not in ("---", "..."):
            return None
    try:
        for key, _, value in (b[0].partition(":") for b in blocks):
            rest = blocks[len(record)][1:]
            if value.strip().startswith("["):
                inner = re.fullmatch(r"\[(.*?),?\s*\]\s*(?:#.*)?", "\n".join([value.strip(), *rest]).strip(), re.S)
                items = re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+)(?:,|$)""", inner.group(1), re.S) if inner else [""]
                record[key] = [_scalar([i]) for i in items]
            elif not re.sub(r"^\s*#.*", "", value).strip() and any(line.lstrip().startswith("- ") for line in rest):
                items = []
                for line in rest:
                    if re.match(r"\s*-(\s|$)", line):
                        items.append([line.lstrip()[1:]])
                    elif line.strip() and items:
                        items[-1].append(line)
                record[key] = [_scalar(i) for i in items]
            else:
                record[key] = _scalar([value, *rest])
    except (ValueError, KeyError, OverflowError):
        return None
    return record if record else None


def load_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rule and term tables of a folder of rule files, each read and parsed in a task.

    The file name is the rule's name.  Rules of files have no place of their own, so they are in order of their names.
    """
    files = (
        spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        .select(F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"([^/=]+)\.yaml(?:/[^/]*)?$", 1).alias("name"), "value")
        .filter("name <> ''")
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, value in zip(batch["name"], batch["value"], strict=True):
                rule, terms = rule_row({**(read_record(value) or {}), "name": name}, 0)
                rows.append((*rule, [dict(zip(("rule", "grp", "term", "field", "op", "value"), t, strict=True)) for t in terms]))
            yield pd.DataFrame(rows, columns=["name", "ord", "active", "description", "query", "tags", "version", "terms"])

    inner = ",".join(":".join(f.split()) for f in TERM_SCHEMA.split(", "))
    read = materialize(files.mapInPandas(parse, f"{RULE_SCHEMA}, terms array<struct<{inner}>>"), "rule-files")
    return read.drop("terms").withColumn("tags", normalize_tags("tags")), read.select(F.explode("terms").alias("t")).select("t.*")
