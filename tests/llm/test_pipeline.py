from __future__ import annotations

from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests.llm.conftest import SF  # noqa: E402
from tests.llm.test_neardup import brute  # noqa: E402
from tests.llm.test_words_and_secrets import brute_spans, brute_windows  # noqa: E402
from vantage.llm import queries  # noqa: E402
from vantage.session import materialize  # noqa: E402


def test_stages_on_their_own_input(spark, docs):
    """Each stage after the first against brute force on what it was given."""
    docs, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), name)
        seen.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    by = {n: (b, a) for n, b, a, _ in seen}
    assert all(c == list(corpus_pipeline.COLUMNS) for _, _, _, c in seen[:-1])
    before, after = by["quality"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert sum(labels.get(d, 0) for d in gone) <= 2 and Counter(after) <= Counter(before)
    before, after = by["near_duplicates"]
    classes = brute([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == set(classes.values()) and len(after) == len(set(classes.values()))
    before, after = by["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert Counter(after) == Counter(r for r in before if not brute_windows(r["text"], items)[-1])
    before, after = by["secrets"]
    assert len(after) == len(before) and not any(brute_spans(r["text"]) for r in after)
    dirty = {r["doc_id"] for r in before if brute_spans(r["text"])}
    assert {r for r in after if r["doc_id"] not in dirty} == {r for r in before if r["doc_id"] not in dirty}
    before, after = by["encoding"]
    assert len(after) == len(before) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in after)


def test_whole_run(spark):
    rows = queries.QUERIES["pipeline"](spark, SF)
    assert rows.count() > 0 and "ids" in rows.columns
