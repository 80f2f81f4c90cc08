"""Queries that SQL does not express, against plain Python on small fixtures and on the smallest tables."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.operators import dataset, monitor, peers, prices, retrieval
from plumbline.plans import dataset_plans
from plumbline.plans.catalog import QUERIES
from plumbline.storage import table


def first_come(rows):
    owner, kept = {}, {}
    for me, links in sorted(rows):
        named = [(i, x) for i, x in enumerate(links) if x is not None]
        first = next((owner[n] for n in named if n in owner), me)
        if first == me:
            owner.update(dict.fromkeys(named, me))
        kept[me] = first
    return kept


def test_first_come_dedupe(spark, sf_dir):
    rng = random.Random(5)
    rows = [(i, f"a{rng.randrange(40)}" if rng.random() < 0.8 else None, f"b{rng.randrange(25)}" if rng.random() < 0.7 else None) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, a string, b string")
    got = {r.id: r.kept for r in dataset.keep_first(frame, "id", [F.col("a"), F.col("b")]).collect()}
    assert got == first_come([(i, (a, b)) for i, a, b in rows])
    docs = table(spark, sf_dir, "documents").collect()
    true = first_come([(r.doc_id, (r.text, r.source + "|" + r.text.split("\n")[0])) for r in docs])
    assert {r.doc_id: r.kept for r in QUERIES["first_come_dedupe"](spark, sf_dir).collect()} == true
    assert dataset.keep_first(frame.limit(0), "id", [F.col("a")]).count() == 0


def test_group_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "source")
    groups = docs.join(dataset.linked_groups(docs, "doc_id", dataset_plans._links()), "doc_id").groupBy("lang", "group").count().collect()
    parts, true = {"train": 0.8, "val": 0.1, "test": 0.1}, {}
    for lang in {r.lang for r in groups}:
        mine = sorted(((r["count"], r.group) for r in groups if r.lang == lang), key=lambda x: (-x[0], x[1]))
        total, filled = sum(n for n, _ in mine), dict.fromkeys(parts, 0)
        for n, group in mine:
            part = max(parts, key=lambda p: parts[p] * total - filled[p])
            filled[part] += n
            true[lang, group] = part
    assert {(r.lang, r.group): r.part for r in QUERIES["group_split"](spark, sf_dir).collect()} == true


def test_rate_limited_accepts(spark, sf_dir):
    events = sorted((r.ts, r.event_id, r.user_id) for r in table(spark, sf_dir, "events").collect())
    recent, true = defaultdict(list), {}
    for ts, event, user in events:
        recent[user] = [x for x in recent[user] if (ts - x).total_seconds() < 86_400]
        true[event] = len(recent[user]) < 3
        if true[event]:
            recent[user].append(ts)
    assert {r.event_id: r.accepted for r in QUERIES["rate_limited_accepts"](spark, sf_dir).collect()} == true


def test_lift_bootstrap_ci(spark, sf_dir):
    values = defaultdict(list)
    for r in table(spark, sf_dir, "events").collect():
        values[r.event_type, r.user_id].append(r.value)
    means = defaultdict(list)
    for (kind, _), xs in values.items():
        means[kind].append(sum(xs) / len(xs))
    for r in QUERIES["lift_bootstrap_ci"](spark, sf_dir).collect():
        xs = means[r.event_type]
        rng = random.Random(1)
        draws = sorted(sum(rng.choices(xs, k=len(xs))) / len(xs) for _ in range(2000))
        assert r.clusters == len(xs) and abs(r["mean"] - sum(xs) / len(xs)) < 1e-9
        width = draws[1949] - draws[50]
        assert abs(r.low - draws[50]) < 0.35 * width and abs(r.high - draws[1949]) < 0.35 * width


def test_stream_windowed_counts(spark, sf_dir):
    """Days that end a day or more before the newest event are closed; each has all of its events."""
    rows = table(spark, sf_dir, "events").collect()
    newest = max(r.ts for r in rows)
    true = Counter((f"{r.ts:%Y-%m-%d}", r.event_type) for r in rows)
    got = {(r.day, r.event_type): r.n for r in QUERIES["stream_windowed_counts"](spark, sf_dir).collect()}
    assert got and all(true[k] == n for k, n in got.items())
    assert {k[0] for k in true} - {k[0] for k in got} <= {f"{newest:%Y-%m-%d}", max(d for d, _ in true), sorted({d for d, _ in true})[-2]}


@pytest.mark.parametrize("band", [0.02, 0.3])
def test_peer_pairs(spark, band):
    rng = random.Random(8)
    rows = [
        (i, rng.choice("ab"), rng.choice(["red", "blue", None]), rng.choice([None, 0.0, -1.0, *(rng.uniform(5, 20) for _ in range(6))]), rng.choice(["USD", "USD", "EUR", None]), rng.choice([True, None, False]))
        for i in range(120)
    ]
    items = spark.createDataFrame(rows, "id long, type string, colour string, price double, currency string, live boolean")
    got = {(r.target_id, r.peer_id): (r.score, r.diff) for r in peers.peer_pairs(items, items, ["type"], ["colour"], [], band, "live").collect()}
    true = {}
    for i, kind, colour, price, code, _ in rows:
        for j, kind2, colour2, price2, code2, live in rows:
            if i == j or kind != kind2 or live is False or (colour and colour2 and colour != colour2) or (code and code != code2):
                continue
            same = bool(price and price2 and price > 0 and price2 > 0 and code and code == code2)
            if not same or abs(price2 - price) <= band * price:
                true[i, j] = (int(colour is not None and colour == colour2) + int(same), abs(price2 - price) if same else None)
    assert got == true


@pytest.mark.parametrize(("band", "k", "fill"), [(0.02, 3, 2), (0.3, 3, 5), (0.3, 2, 1), (0.6, 50, 4)])
def test_nearest_peers_are_the_top_of_all_pairs(spark, band, k, fill):
    rng = random.Random(18)
    rows = [
        (i, rng.choice(["a", "b", None]), rng.choice(["red", "blue", None]), rng.choice("xy"), rng.choice(["p", "q", None]), rng.choice([None, 0.0, -1.0, 10.0, 10.0, *(float(rng.randint(8, 14)) for _ in range(6))]), rng.choice(["USD", "USD", "EUR", None]), rng.choice([True, True, None, False]))
        for i in range(200)
    ]
    items = spark.createDataFrame(rows, "id long, type string, colour string, brand string, thing string, price double, currency string, live boolean")
    arguments = (items, items, ["type"], ["colour"], ["brand", "thing"], band, "live")
    order = ["target_id", "rank", "peer_id", "score", "diff", "tolerant_known"]
    true = sorted(map(tuple, peers.top_peers(peers.peer_pairs(*arguments), k, fill).select(*order).collect()), key=lambda r: r[:2])
    assert true == sorted(map(tuple, peers.nearest_peers(*arguments, k, fill).select(*order).collect()), key=lambda r: r[:2])
    plan = peers.nearest_peers(*arguments, k, fill)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # of targets with the least ids of their key, one row a key; items meet no items
    counted = {r.target_id: r.n for r in peers.peer_pairs(items, items, ["type", "brand"], ["colour"], [], band).groupBy("target_id").count().withColumnRenamed("count", "n").collect()}
    assert counted == {r.target_id: r.n for r in peers.peer_counts(items, ["type", "brand"], ["colour"], band).where("n > 0").collect()}


def test_constants_of_price_signals(spark):
    """Fence 3 and discount 0.5: one planted row each on either side."""
    rows = [("a", float(p)) for p in (10, 10.5, 11, 11.5, 12, 12.5, 13, 13.5, 14, 14.5, 15)] + [("a", 60.0), ("a", 28.0), ("b", 900.0)]
    frame = spark.createDataFrame(rows, "g string, price double")
    assert [r.price for r in prices.outliers(frame, ["g"], "price").collect()] == [60.0]
    flagged = spark.createDataFrame([(0.5, 9.0, 9.0), (0.49, 9.0, 9.0), (0.1, 21.0, 10.0), (0.1, 21.0, 15.1)], "d double, list double, price double")
    flag = prices.suspicious(F.col("d"), F.col("list"), F.col("price"), F.lit(15.0), F.lit(20.0))
    assert [r.x for r in flagged.select(flag.alias("x")).collect()] == [True, False, True, False]
    runs = spark.createDataFrame([(u, i, i < n) for u, n in ((1, 14), (2, 15)) for i in range(16)], "u int, i int, bad boolean")
    assert {r.u: r.disabled for r in monitor.failure_runs(runs, "u", ["i"], F.col("bad"), 15).collect()} == {1: False, 2: True}


def test_eligible_counts_equal_pairs(spark):
    from plumbline.operators import peers

    rows = [(i, (None, "a", "b")[i % 3], (None, "red", "blue", "red")[i % 4], (None, 1)[i % 2]) for i in range(40)] + [(99, "lonely", "red", 1)]
    items = spark.createDataFrame(rows, "id int, type string, colour string, thing int")
    got = {r.target_id: r.n for r in peers.eligible_counts(items, ["type"], ["colour", "thing"]).collect()}
    fits = lambda x, y: x is None or y is None or x == y
    assert got == {t[0]: sum(t[0] != c[0] and t[1] == c[1] and fits(t[2], c[2]) and fits(t[3], c[3]) for c in rows) for t in rows}
    assert got[99] == 0
    steps = [("strict", items.selectExpr("id target_id", "cast(id % 3 as long) n")), ("loose", items.selectExpr("id target_id", "cast(if(id = 3, 0, id) as long) n"))]
    chosen = {r.target_id: (r.step, r.n) for r in peers.widened(steps, 2).collect()}
    assert (chosen[1], chosen[2], chosen[3 + 1], chosen[9]) == (("loose", 1), ("strict", 2), ("loose", 4), ("loose", 9)) and 3 not in chosen and 0 not in chosen


def test_token_cosine_in_chunks(spark, monkeypatch):
    """Every pair of every two chunks once, terms beyond the matrices, keys in two blocks, rows without a key, block or term."""
    monkeypatch.setattr(retrieval, "CHUNK_TEXTS", 7)
    monkeypatch.setattr(retrieval, "DENSE_TERMS", 3)
    rng = random.Random(8)
    rows = [(i, "ab"[i % 2], " ".join(rng.choices("v w x y z".split(), (9, 5, 3, 1, 1), k=rng.randrange(1, 7)))) for i in range(40)]
    rows += [(i, "ba"[i % 2], " ".join(rng.choices("v w x u".split(), k=3))) for i in range(12)]
    frame = spark.createDataFrame([*rows, (None, "a", "v w"), (90, None, "v w"), (91, "a", ""), (92, "b", None)], "id long, block string, text string")
    tokens = F.filter(F.split("text", " "), lambda w: w != "")
    found = retrieval.token_cosine(frame, "id", "block", tokens, 0.7).collect()
    counts = defaultdict(Counter)
    for i, block, text in rows:
        counts[i].update((block, w) for w in text.split())
    norm = {i: sum(n * n for n in c.values()) ** 0.5 for i, c in counts.items()}
    true = {(i, j): sum(n * counts[j][k] for k, n in counts[i].items()) / (norm[i] * norm[j]) for i in counts for j in counts if i < j}
    assert {(r.a, r.b): r.cosine for r in found} == pytest.approx({k: v for k, v in true.items() if v >= 0.7}) and len(found) == len({(r.a, r.b) for r in found}) > 50
    assert retrieval.token_cosine(frame.limit(0), "id", "block", tokens, 0.7).count() == 0
    # Pairs of chunks held both chunks' texts in their rows, all of a block's in one task.
    plan = retrieval.token_cosine(frame, "id", "block", tokens, 0.7)._jdf.queryExecution().optimizedPlan().toString()
    assert "file" in plan and "rows" not in plan.replace("Rows", "") and "one#" not in plan


def test_similar_top_equals_pairs(spark, monkeypatch):
    """Done by the first items or by whole groups, targets and items that lack a close column, and few pairs where copies abound."""
    rng = random.Random(4)
    pick = lambda xs: rng.choice(xs)
    rows = [(i, pick("pq"), pick("bc"), pick("xyz"), pick(("red", "blue", None)), rng.choice((90.0, 91.0, 95.0, 140.0)), pick(("USD", "USD", None))) for i in range(300)]
    rows += [(300 + i, *(pick((v, v, None)) for v in ("p", "b", "x")), "red", 90.0, "USD") for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, p_type string, p_brand string, thing string, colour string, price double, currency string")
    generators, close = [["p_brand"], ["p_type", "thing"]], ["p_type", "p_brand", "thing"]

    def parts(a, b):
        same = peers.comparable(a("price"), b("price"), a("currency"), b("currency"))
        equal = {c: (w, peers.equal_or_unknown(a(c), b(c))) for c, w in (("p_type", 0.15), ("p_brand", 0.25), ("colour", 0.10), ("thing", 0.10))}
        return equal | {"price": (0.15, F.when(same, peers.band_score(a("price"), b("price"), 0.02)))}

    best = defaultdict(list)
    for r in peers.similar_pairs(frame, generators, parts, 0.6).collect():
        best[r.target_id].append((-r.score, r.peer_id))
    true = {(t, i + 1, peer, -less) for t, xs in best.items() for i, (less, peer) in enumerate(sorted(xs)[:10])}
    asked = []
    whole = peers.similar_pairs
    monkeypatch.setattr(peers, "similar_pairs", lambda targets, *a: asked.append(targets.count()) or whole(targets, *a))
    for first in (5, 25, 200):
        found = peers.similar_top(frame, generators, parts, 0.6, close, 0.8667, first=first)
        assert {tuple(r) for r in found.collect()} == true and found.count() == len(true)
    assert asked[0] == 360 and asked[4] < asked[2] < 360


def test_stream_change_events_in_several_batches(spark, tmp_path):
    """A later batch meets the last snapshot of each key, nulls and late rows included."""
    from plumbline.streaming import changes

    schema = "event_id long, ts timestamp, user_id long, event_type string, level long, k int"
    batches = [
        [(1, 10, 1, "a", 1, 1), (2, 20, 1, "a", 2, 1), (3, 5, 2, "a", 7, None), (4, 6, 2, "a", 7, 2)],
        [(5, 15, 1, "a", 2, 3), (6, 30, 3, "b", 1, 1)],
        [(7, 40, 2, "a", 7, 2), (8, 1, 1, "a", 9, 3), (9, 2, 1, "a", 9, 3), (10, 50, 3, "b", 1, 2)],
    ]
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame([(e, t, u, x, lv, k) for e, t, u, x, lv, k in rows], "event_id long, t long, user_id long, event_type string, level long, k int")
        frame.coalesce(1).selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "event_type", "level", "k").write.parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in" / "b=*"))
    got = sorted((r.event_id, r.user_id, r.event_type, r.field, r.before, r.after) for r in changes.change_events_once(stream, "changes").collect())
    assert got == [
        (2, 1, "a", "level", "1", "2"), (4, 2, "a", "k", None, "2"), (5, 1, "a", "k", "1", "3"), (8, 1, "a", "level", "2", "9"), (10, 3, "b", "k", "1", "2"),
    ]
