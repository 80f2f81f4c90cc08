"""Archived pages, similarity within sets and diffs of versions against plain Python."""

import difflib
import gzip
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import histories, retrieval
from plumbline.plans.catalog import QUERIES
from plumbline.sources import archives as a
from plumbline.storage import table

BODY = "<p>añejo €</p>"
RAW = BODY.encode()


@pytest.mark.parametrize(
    ("headers", "body", "expected"),
    [
        ("Content-Type: text/html; charset=utf-8\r\n", RAW, BODY),
        ("", RAW, BODY),
        ("Content-Type: text/html\r\nTransfer-Encoding: chunked\r\n", a.chunked(RAW, 3), BODY),
        ("Content-Type: text/html\r\nContent-Encoding: gzip\r\nTransfer-Encoding: Chunked\r\n", a.chunked(gzip.compress(RAW), 7), BODY),
        ("Content-Type: text/html\r\nContent-Encoding: deflate\r\n", zlib.compress(RAW), BODY),
        ("Content-Type: text/html; charset=latin-1\r\n", "añejo".encode("latin-1"), "añejo"),
        ("Content-Type: text/html\r\n", b'<meta charset="cp1252">' + "€".encode("cp1252"), '<meta charset="cp1252">€'),
        ("Content-Type: text/html; charset=no-such\r\n", RAW, BODY),
        ("Content-Type: text/html\r\n", b"\xff<p>", "�<p>"),
        ("Content-Type: text/html\r\nContent-Encoding: br\r\n", RAW, None),
        ("Content-Type: application/json\r\n", RAW, None),
        ("Content-Type: text/html\r\nContent-Encoding: gzip\r\n", b"no gzip", None),
        ("Content-Type: text/html\r\nTransfer-Encoding: chunked\r\n", b"zz\r\nno\r\n", None),
        ("Content-Type: text/html\r\n", b"", ""),
    ],
)
def test_pages_of_records(headers, body, expected):
    assert a.page_of(a.record("http://x.example/", 200, headers, body)) == expected
    assert a.page_of(a.record("http://x.example/", 404, headers, body)) is None


def test_no_pages(monkeypatch):
    assert a.page_of(b"") is None and a.page_of(b"junk") is None and a.page_of(gzip.compress(b"HTTP/1.1 200 OK\r\n\r\nx")) is None
    assert a.page_of(gzip.compress(b"WARC/1.0\r\nWARC-Type: request\r\n\r\nHTTP/1.1 200 OK\r\n\r\nx")) is None
    monkeypatch.setattr(a, "MOST_BYTES", 1000)
    assert a.page_of(a.record("http://x.example/", 200, "", b"x" * 5000)) is None  # a member that unpacks to more than a page


def test_newest_good_captures(spark):
    rows = [
        ("http://www.Shop.example/p/", "2024", 200, "text/html", "f1", 10, 5), ("https://shop.example/p", "2025", 404, "text/html", "f1", 20, 5), ("https://shop.example/p?q=1", "2026", 200, "text/html", "f1", 30, 5),
        ("https://shop.example/p", "2024", 200, "text/html", "f0", 40, 5), ("https://shop.example/p", "2026", 200, "image/png", "f1", 50, 5), ("https://shop.example/p", "2023", 200, "text/html", "f1", 60, 5),
        ("https://shop.example/p", "2027", 200, "text/html", None, 70, 5), ("https://shop.example/p", "2028", 200, "text/html", "f1", 80, 0), (None, None, None, None, None, None, None),
    ]
    index = spark.createDataFrame(rows, a.CAPTURE)
    assert sorted((r.page, r.timestamp, r.filename, r.offset) for r in a.newest(index).collect()) == [("shop.example/p", "2024", "f0", 40), ("shop.example/p?q=1", "2026", "f1", 30)]
    assert [r.timestamp for r in a.newest(index, F.lit("2024")).collect()] == ["2023"]
    assert a.fetched(a.newest(index.limit(0))).count() == 0


def test_members_are_read_where_the_index_says(spark):
    bodies = [(f"http://s.example/{i}", "2024", 200, "text/html", "Content-Type: text/html\r\n", f"<p>{i}</p>".encode() * (i * 50)) for i in range(60)]
    captures = spark.createDataFrame(bodies, "url string, timestamp string, status int, mime string, headers string, body binary").repartition(4)
    index = a.write(spark, captures)
    got = {r.url: r.html for r in a.fetched(a.newest(index)).collect()}
    assert got == {u: b.decode() for u, *_, b in bodies} and index.select("filename").distinct().count() == 4


# Similarity within sets.


def plain_cosines(target, others):
    docs = [Counter(w for w in re.findall(r"\w\w+", (t or "").lower())) for t in (target, *others)]
    df = Counter(w for d in docs for w in d)
    weigh = lambda d: {w: n * (1 + math.log((1 + len(docs)) / (1 + df[w]))) for w, n in d.items()}
    first, *rest = map(weigh, docs)
    for text, other in zip(others, rest, strict=True):
        long = math.sqrt(sum(v * v for v in first.values()) * sum(v * v for v in other.values()))
        if not (target or "").strip() or not (text or "").strip():
            yield None
        else:
            yield pytest.approx(sum(v * other.get(w, 0) for w, v in first.items()) / long) if long else 0.0


def test_set_cosines(spark):
    texts = {1: "Red cotton tee, soft", 2: "red tee", 3: "blue shirt", 4: None, 5: "", 6: "red red RED tee", 7: "a b", 8: "señal única", 9: "  "}
    sets = {"x": (1, [2, 3, 4, 5, 6, 7]), "y": (8, [1, 8 + 92]), "empty": (9, [1, 2]), "short": (7, [1]), "alone": (2, [])}
    texts[100] = "una señal"
    members = [(s, t, True) for s, (t, _) in sets.items()] + [(s, o, False) for s, (_, os) in sets.items() for o in os]
    frame = spark.createDataFrame(list(texts.items()), "id long, text string")
    found = retrieval.set_cosines(spark.createDataFrame(members, "s string, id long, target boolean"), frame, "s", "id", F.col("text"))
    got = {(r.s, r.id): r.cosine for r in found.collect()}
    assert got == {(s, o): c for s, (t, os) in sets.items() for o, c in zip(os, plain_cosines(texts[t], [texts[o] for o in os]), strict=True)}


# Diffs.


def cut(text):
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text or "") if s.strip(" ")]


def test_diffs_of_all_turns_equal_the_library(spark, sf_dir):
    got = {(r.conv_id, r.role, r.turn): (r.added, r.removed, r["diff"]) for r in QUERIES["version_diffs"](spark, sf_dir).collect()}
    true, last = {}, {}
    for r in sorted(table(spark, sf_dir, "conversations").collect(), key=lambda r: (r.conv_id, r.role, r.turn)):
        before = last.get((r.conv_id, r.role))
        if before is not None and cut(before) != cut(r.text):
            lines = list(difflib.unified_diff(cut(before), cut(r.text), "before", "after", lineterm="", n=1))
            true[r.conv_id, r.role, r.turn] = (sum(x.startswith("+") for x in lines[2:]), sum(x.startswith("-") for x in lines[2:]), "\n".join(lines))
        last[r.conv_id, r.role] = r.text or ""
    assert got == true and len(true) > 20


def test_diffs_of_versions(spark):
    rows = [(1, 1, "A. B. C."), (1, 2, "A. C. D."), (1, 3, "A.  C.\nD."), (1, 4, None), (1, 5, ""), (2, 1, "only"), (3, 1, None), (3, 2, "new")]
    found = histories.version_diffs(spark.createDataFrame(rows, "id int, at int, text string"), ["id"], ["at"], "text").collect()
    assert sorted((r.id, r["at"], r.added, r.removed) for r in found) == [(1, 2, 1, 1), (1, 4, 0, 3), (3, 2, 1, 0)]
    assert next(r["diff"] for r in found if (r.id, r["at"]) == (1, 2)) == "--- before\n+++ after\n@@ -1,3 +1,3 @@\n A.\n-B.\n C.\n+D."


def test_pages_of_one_address_and_fragment_stay_apart(spark, tmp_path):
    """Two pages whose addresses differ in nothing, fragment included, were fetched as one."""
    rows = [(1, "https://a.example/x#top", "<p>1"), (2, "https://a.example/x#top", "<p>2"), (3, "https://a.example/x?y=1#top", "<p>3"), (4, "https://a.example/x", "<p>4")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in QUERIES["archived_pages"](spark, str(tmp_path)).collect()) == [1, 2, 3, 4]


def test_lines_of_hinted_pages_are_not_shuffled(spark, tmp_path, monkeypatch):
    lines = [f'_:n{i} <http://schema.org/Name> "{"a ring" if i % 5 == 0 else "stringy"}" <http://x/{i}> .' for i in range(40)] + [f'_:n{i} <http://schema.org/x> "v" <http://x/{i}> .' for i in range(40)]
    spark.createDataFrame([(x,) for x in [*lines, "none"]], "value string").repartition(3).write.option("compression", "gzip").text(str(tmp_path / "parts"))
    expected = sorted((f"_:n{i}", f"http://x/{i}") for i in range(0, 40, 5) for _ in range(2))
    for most, shuffled in ((a.MOST_SENT, False), (7, True)):
        monkeypatch.setattr(a, "MOST_SENT", most)
        found = a.hinted_statements(spark, str(tmp_path / "parts"), r'Name> "[^"]*\bring\b')
        assert ("SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()) is shuffled
        assert sorted((r.subject, r.graph) for r in found.collect()) == expected
