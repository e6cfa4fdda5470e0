"""Secret scan: a trigram inverted index narrows the documents each rule is run on.

From the syntax tree of a rule's regular expression a Boolean trigram query is derived (an OR of ANDs, over lower-cased
text).  Documents are posted under the trigrams any query needs; intersecting the postings of a conjunction gives its
candidate documents, and only those are searched with the expression.  A rule without mandatory trigrams, such as a
run of hexadecimal digits, is run on every document.  DataFrame expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import text_key
from vantage.session import local_table

MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`; those whose `group` has fewer than `least` characters are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


# The kinds and expressions of the base, in the order they are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    Rule("hex", r"([0-9a-f]{24,})", 1, 24),
)
MORE = (
    Rule("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1),
    Rule("web_token", r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 30),
    Rule("forge_token", r"(gh[pousr]_[A-Za-z0-9]+)", 1, 40),
)
RULES = BASE + MORE

#: Matches of a text that are added up at a time.
CHUNK = 1024


def _grams(strings: set[str]) -> set[frozenset[str]]:
    """The query of "one of these strings": an OR of the ANDs of their trigrams."""
    return {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}


def _both(a: set[frozenset[str]], b: set[frozenset[str]]) -> set[frozenset[str]]:
    """a AND b; left weaker (still necessary) if it would grow too long."""
    if len(a) * len(b) > MAX_STRINGS:
        return min(a, b, key=len)
    return {x | y for x, y in product(a, b)}


ALWAYS = {frozenset()}


def _walk(tree) -> tuple[set[str] | None, set[frozenset[str]]]:
    """(the only strings the tree matches, or None; a query every match satisfies)."""
    query, run, exact = ALWAYS, {""}, True
    for op, arg in tree:
        if op is sre.SUBPATTERN:
            strings, more = _walk(arg[-1])
        elif op is sre.LITERAL:
            strings, more = {chr(arg).lower()}, ALWAYS
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            strings, more = {chr(c).lower() for _, c in arg}, ALWAYS
        elif op is sre.BRANCH:
            sides = [_walk(side) for side in arg[1]]
            known = [s for s, _ in sides]
            strings = None if None in known else set().union(*known)
            more = set().union(*(q for _, q in sides)) if strings is None else ALWAYS
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            strings, more = _walk(inner)
            if (low, high) == (0, 1) and strings is not None:
                strings = strings | {""}
            elif low == high == 1:
                pass
            else:
                strings, more = None, more if low else ALWAYS
        else:
            strings, more = None, ALWAYS
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        query = _both(_both(query, _grams(run)), more if strings is None else _grams(strings))
        run, exact = {""}, False
    return (run, ALWAYS) if exact else (None, _both(query, _grams(run)))


def trigram_query(pattern: str) -> list[list[str]]:
    """Conjunctions of trigrams one of which every match's lower-cased text holds; empty if there are no mandatory ones."""
    strings, query = _walk(sre_parser.parse(pattern))
    query = _grams(strings) if strings is not None else query
    least = {c for c in query if not any(o < c for o in query)}
    return [] if frozenset() in least else sorted(sorted(c) for c in least)


def postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index over the trigrams in use: rows (gram, doc_id, text_key)."""
    low = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lower(text_col).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.withColumn("held", held).where(F.size("held") > 0).select("doc_id", text_key(F.col("text")).alias("text_key"), F.explode("held").alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Intersected postings: rows (doc_id, text_key, kinds), the rules whose query the document satisfies."""
    terms = [
        (gram, n, rule.kind, 1 << bit, (1 << len(grams)) - 1)
        for n, (rule, grams) in enumerate((r, c) for r in rules for c in trigram_query(r.pattern))
        for bit, gram in enumerate(grams)
    ]
    table = local_table(index.sparkSession, terms, "gram string, conjunction int, kind string, bit long, whole long")
    return (
        index.join(F.broadcast(table), "gram").groupBy("doc_id", "text_key", "conjunction", "kind", "whole")
        .agg(F.bit_or("bit").alias("bits")).where("bits = whole")
        .groupBy("doc_id", "text_key").agg(F.collect_set("kind").alias("kinds"))
    )


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points of the rule's matches in `text`.

    Splitting at the matches gives the gaps between them; gaps and matches add up to positions.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.zip_with(
        F.arrays_zip(matches.alias("m"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("g")), F.slice(F.split(text, rule.pattern), 1, F.greatest(F.size(matches), F.lit(0))),
        lambda x, gap: F.struct(F.char_length(gap).alias("gap"), F.char_length(x["m"]).alias("size"), (F.char_length(x["g"]) >= rule.least).alias("kept")),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + part["size"]
        found = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(part["kept"], F.concat(state["found"], found)).otherwise(state["found"]).alias("found"))

    def placed(parts: Column, at: Column) -> Column:
        return F.aggregate(parts, F.struct(at.alias("at"), none.alias("found")), step, lambda s: s["found"])

    def by_chunks(parts: Column) -> Column:
        """Lists grow by copying, so a text of very many matches is added up a chunk at a time."""
        last = F.floor((F.size(parts) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)))
        return bound(chunks, lambda cs: F.flatten(F.zip_with(cs, starts(cs), placed)))

    def starts(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + p["gap"] + p["size"]))
        first = F.array(F.lit(0))
        return F.aggregate(sizes, first, lambda held, n: F.concat(held, F.array(F.element_at(held, -1) + n)), lambda held: F.slice(held, 1, F.size(held) - 1))

    return bound(parts, lambda p: F.when(F.size(p) <= CHUNK, placed(p, F.lit(0))).otherwise(by_chunks(p)))


def bound(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbered(n: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("ord"), s["end"].alias("end"))


def _of(n: int):
    return lambda s: s["ord"] == n


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (doc_id, text, input, found): the input row as a struct; `found` has (start, ord, end) of all spans by start, then rule order.

    Null text has no spans and stays null; null ids and repeated rows stay, one row for each; other columns are ignored; an
    empty table gives no rows.  Every rule leaves a place after one look at the run that begins there, so the time of a text
    grows with its length, however long its runs are.
    """
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    grams = sorted({g for q in queries.values() for c in q for g in c})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"), F.struct("*").alias("input"))
    found = candidates(postings(docs, grams, id_col, text_col), rules).select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), "kinds")
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")), "left")
    none = F.array().cast("array<struct<start:int,ord:int,end:int>>")
    each = []
    for n, rule in enumerate(rules):
        due = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) if queries[rule.kind] else F.coalesce(F.col("text").rlike(rule.pattern), F.lit(False))
        each.append(F.when(due, F.transform(spans(F.col("text"), rule), _numbered(n))).otherwise(none))
    return rows.select("doc_id", "text", "input", F.array_sort(F.concat(*each)).alias("found"))


def listing(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """Counts and digests of a scan; the first `base` rules are the base."""
    counts = [F.size(F.filter("found", _of(n))).cast("long").alias(f"n_{rules[n].kind}") for n in range(base)]
    own = F.filter(F.col("found"), lambda s: s["ord"] < base)
    return scanned.select("doc_id", *counts, F.sha2(listing(own, rules), 256).alias("base_sha256"), listing(F.col("found"), rules).alias("spans"))


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """`text` with every run of overlapping spans replaced by `mark`."""

    def step(state: Column, s: Column) -> Column:
        before = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        new = F.struct(s["end"].alias("at"), F.concat(state["out"], before, F.lit(mark)).alias("out"))
        longer = F.struct(F.greatest(s["end"], state["at"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] >= state["at"], new).otherwise(longer)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(found, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)
