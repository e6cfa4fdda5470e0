"""Pages from the summary against pages that skip a list of shown addresses."""

from __future__ import annotations

import random

import pytest

from tests.test_fixtures import documents
from vantage.operators import search as S
from vantage.session import local_table

END = 40 * S.DAY


def _docs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(260):
        # hits crowd on a few days, so windows grow, stop in the middle and go on
        last = rng.choice([END, END - 9 * S.DAY, END - 9 * S.DAY - 5, END - 10 * S.DAY, END - 30 * S.DAY]) - rng.choice([0, 0, 1, S.DAY, 3 * S.DAY - 1])
        rows.append({"uid": f"u{i}", "ip": f"8.8.8.{rng.randrange(90)}", "port": [rng.choice(["80", "81"])], "first_seen": last - rng.randrange(9), "last_seen": last, "fqdn_requested": [f"n{i % 3}.org"]})
    return documents(spark, rows).cache()


@pytest.mark.parametrize("limit, start", [(7, 0), (30, END - 31 * S.DAY + 77)])
def test_pages_equal_seen_lists(spark, limit, start):
    docs, groups = _docs(spark), S.search_terms("port:80")
    summary = S.summarize(docs, groups, (start, END))
    cursor, days, shown, pages = S.Cursor(END), 1, [], 0
    while cursor is not None:
        at = cursor.at
        seen = local_table(spark, [(ip,) for ip in shown], "ip string")
        old = S.search_page(docs, groups, (start, END), at, seen, limit, days)
        page, cursor = S.next_page(summary, cursor, limit, days)
        rows = page.rows.collect()
        assert rows == old.rows.collect()
        info, want = page.info.first().asDict(), old.info.first().asDict()
        shown += [r.ip for r in rows]
        assert info.pop("shown") == len(shown) and info == want and page.window == old.window
        assert (cursor is not None) == want["has_more"]
        days = 1 if rows else days * 2
        pages += bool(rows)
    assert len(set(shown)) == len(shown) and pages > 2
    assert set(shown) == {r.ip for r in docs.filter("last_seen >= %d AND array_contains(port, '80')" % start).select("ip").distinct().collect()}


def test_all_pages_and_names(spark):
    docs, groups = _docs(spark), S.search_terms("port:81")
    pages = list(S.search_pages(docs, groups, (0, END), 40))
    order = [(-r.max_seen, r.ip) for p in pages for r in p.rows.collect()]
    assert order == sorted(order) and len({ip for _, ip in order}) == len(order)
    names = S.page_names(docs, groups, pages[0]).collect()
    assert {r.ip for r in names} == {r.ip for r in pages[0].rows.collect()} and all(len(r.requested) == 1 for r in names)
    assert list(S.search_pages(docs.limit(0), groups, (0, END), 40)) == []


def test_a_page_reads_a_range(spark):
    summary = S.summarize(_docs(spark), S.search_terms("port:80"), (0, END))
    plan = summary.table.filter("newest BETWEEN 5 AND 9")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(newest,5)" in plan and "LessThanOrEqual(newest,9)" in plan
