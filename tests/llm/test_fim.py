from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vantage.llm import fim, queries


def slow(doc_id, text):
    """The whole transformation on a list of tokens."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_containers_select_every_rank():
    rng = np.random.default_rng(0)
    cases = [np.array([5]), np.arange(fim.SPAN), np.arange(100, 60_000), np.sort(rng.choice(fim.SPAN, 30_000, False)),
             np.sort(rng.choice(fim.SPAN, 50, False)), np.arange(0, fim.SPAN, 2), np.array([0, fim.SPAN - 1])]
    kinds = set()
    for places in cases:
        for kind in (fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer):
            held = kind(places)
            ranks = {0, len(places) - 1, *rng.integers(0, len(places), 200).tolist()}
            assert [held.select(k) for k in ranks] == [int(places[k]) for k in ranks]
        kinds.add(type(fim.container(places)))
    assert len(kinds) == 3


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abYZ<>PSM \n@[`{"), st.characters(codec="utf-8")), max_size=60), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_equal_token_lists(text, first, second):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((first % (len(units) + 1), second % (len(units) + 1)))
    assert fim.cuts(text, first, second) == (len(units), len("".join(units[:a])), len("".join(units[:b])))


def test_cuts_across_containers():
    rng = random.Random(3)
    texts = ["x" * (3 * fim.SPAN), "漢" * fim.SPAN, "a" * fim.SPAN + "b", " " * (fim.SPAN + 1), "ab c" * fim.SPAN,
             "".join(rng.choice(["word", " ", "漢", "🎉"]) for _ in range(150_000))]
    for text in texts:
        ends = [0, *(m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text))]
        found = fim.boundaries(text)
        assert len(found) == len(ends)
        for k in {0, len(ends) - 1, *(rng.randrange(len(ends)) for _ in range(300))}:
            assert found.select(k) == ends[k]


def test_transform(make, odd_rows, docs):
    rows = [*odd_rows, (20, "<P> has a mark"), (21, "no <M> cut"), (22, "<<S"), (23, "a"), *((i, f"ends < with <{i}> S> P>") for i in range(30, 120))]
    got = fim.transform(make(rows)).collect()
    want = sorted([repr((i, *slow(i, t), t or "")) for i, t in rows])
    assert sorted(repr(tuple(r)) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in fim.transform(docs).collect():
        assert tuple(r)[1:] == (*slow(r["doc_id"], given[r["doc_id"]]), given[r["doc_id"]] or "")
    assert fim.transform(make([])).count() == 0


def test_reference_sql(docs):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.OP12_SQL})").fetchall()
    assert sorted(want) == sorted(map(tuple, fim.digests(docs).select(*names).collect()))
