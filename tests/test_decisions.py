"""Bootstrap intervals, caches, budgets, approvals and attribution against plain Python."""

import hashlib
import math
import random
import re
import unicodedata
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators import decisions as d
from plumbline.operators import experiments as x
from plumbline.operators import matching
from plumbline.plans import answer_plans, decision_plans
from plumbline.plans.catalog import QUERIES


def plain_weights(cluster, draws, seed):
    out = []
    for b in range(-(-draws // 4)):
        h = hashlib.md5(f"{seed}:{b}:{cluster}".encode()).hexdigest()
        out += [sum(int(h[8 * i : 8 * i + 8], 16) >= p for p in x.POISSON) for i in range(4)]
    return out[:draws]


def test_weights_are_poisson(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("c")).select("c", x.weights(F.col("c"), 50, 3).alias("w")).collect()
    assert all(list(r.w) == plain_weights(r.c, 50, 3) for r in rows)
    every = [w for r in rows for w in r.w]
    assert abs(sum(every) / len(every) - 1) < 0.03 and abs(sum(w == 0 for w in every) / len(every) - math.exp(-1)) < 0.02


def test_intervals_of_ratios(spark):
    rng = random.Random(2)
    rows = [(s, rng.randrange(12) or None, rng.random() < 0.5, rng.choice([None, 1, 2, 5])) for s in "ab" for _ in range(90)] + [("c", 1, True, None)]
    frame = spark.createDataFrame(rows, "s string, k int, hit boolean, place int")
    ratios = {"rate": (F.col("hit").cast("int"), F.lit(1)), "mean": (F.col("place"), F.when(F.col("place").isNotNull(), 1))}
    got = {r.s: r for r in x.cluster_intervals(frame, ["s"], ["k"], ratios, draws=101, seed=7).collect()}
    for scope in "abc":
        by = defaultdict(lambda: [0, 0, 0, 0])
        for s, k, hit, place in rows:
            if s == scope:
                by["-" if k is None else str(k)] = [a + b for a, b in zip(by["-" if k is None else str(k)], (hit, 1, place or 0, place is not None), strict=True)]
        w = {k: plain_weights(k, 101, 7) for k in by}
        for i, name in ((0, "rate"), (2, "mean")):
            total = lambda i, draw=None: sum(v[i] * (1 if draw is None else w[k][draw]) for k, v in by.items())  # noqa: B023, E731
            draws = sorted(total(i, t) / total(i + 1, t) for t in range(101) if total(i + 1, t))
            true = [total(i) / total(i + 1) if total(i + 1) else None] + [draws[min(len(draws) - 1, int(q * len(draws)))] if draws else None for q in (0.025, 0.975)]
            assert [got[scope][name], got[scope][f"{name}_low"], got[scope][f"{name}_high"]] == [None if v is None else pytest.approx(v) for v in true]
        assert got[scope].clusters == len(by)


def test_paired_difference_uses_shared_clusters_only(spark):
    rows = [(k, arm, v) for k in range(30) for arm, v in ((True, 3.0), (False, 1.0))] + [(99, True, 1000.0), (98, False, 1000.0), (1, None, 1000.0)]
    frame = spark.createDataFrame(rows, "k int, arm boolean, v double")
    r = x.paired_difference(frame, [], ["k"], F.col("arm"), (F.col("v"), F.lit(1)), draws=40).first()
    assert (r.clusters, r.value, r.low, r.high) == (30, 2.0, pytest.approx(2.0), pytest.approx(2.0))
    assert x.paired_difference(frame.where("arm"), ["k"], ["k"], F.col("arm"), (F.col("v"), F.lit(1)), draws=8).count() == 0


def plain_cache(rows, ttl):
    fetched, out = {}, {}
    for key, at, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        hit = key in fetched and at - fetched[key][0] < ttl
        if not hit:
            fetched[key] = (at, i)
        out[key, i] = (hit, fetched[key][1])
    return out


@pytest.mark.parametrize("spread", [3, 40, 4000])
def test_cache_equals_a_walk(spark, spread):
    rng = random.Random(spread)
    rows = [(rng.choice("aaaaab"), rng.randrange(-spread, spread) * 5, i) for i in range(400)] + [("lone", 7, 1000), ("pair", 0, 1001), ("pair", 100, 1002), ("edge", 0, 1), ("edge", 99, 2), ("edge", 199, 3)]
    frame = spark.createDataFrame([(*r, "x") for r in rows] + [(None, 1, 5000, "x"), ("a", None, 5001, "x")], "k string, t long, i long, slice string")
    got = {(r.k, r.i): (r.hit, r.served_by) for r in d.result_cache(frame, "k", F.col("t"), "i", 100).collect()}
    assert got == plain_cache(rows, 100)
    assert d.result_cache(frame.limit(0), "k", F.col("t"), "i", 100).count() == 0


def plain_spend(rows, cap, per_call):
    left, out = {}, {}
    for day, at, i, cost in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        have = left.setdefault(day, Decimal(cap))
        ok = cost is not None and 0 <= Decimal(str(cost)) <= min(Decimal(per_call), have)
        out[i] = (ok, have if ok else None)
        left[day] = have - Decimal(str(cost)) if ok else have
    return out


@pytest.mark.parametrize("costs", [[1, 99, 100, 50], [0.5, 7.25, 33.3], [100, 60, 30, 15, 8, 4, 2, 1]])
def test_spend_equals_a_walk(spark, costs):
    rng = random.Random(len(costs))
    rows = [(f"d{rng.randrange(3)}", rng.randrange(500), i, rng.choice([*costs, None]) if i % 50 else 0) for i in range(300)]
    frame = spark.createDataFrame([(a, b, c, None if v is None else float(v)) for a, b, c, v in rows], "day string, t long, i long, cost double")
    got = {r.i: (r.accepted, r.left) for r in d.reserved_spend(frame, "day", F.floor(F.col("t") / 60), ["t", "i"], "cost", 200.0, 90.0).collect()}
    assert got == plain_spend(rows, 200, 90)
    assert {True, False} == {x[0] for x in got.values()}
    assert d.reserved_spend(frame.limit(0), "day", F.lit(0), ["t", "i"], "cost", 1.0, 1.0).count() == 0


def test_approvals_step_by_step():
    none = (None, None, None)
    asked, outcome = d.approval_step(none, "request", "ann", 1)
    assert (asked, outcome) == ((1, "ann", "pending"), "opened")
    assert d.approval_step(asked, "request", "bob", 2) == (asked, "reused")
    assert d.approval_step(asked, "approve", "ann", 3) == (asked, "refused")  # not by who asked
    assert d.approval_step(asked, "use", "ann", 3) == (asked, "refused")
    granted, outcome = d.approval_step(asked, "approve", "bob", 3)
    assert (granted, outcome) == ((1, "ann", "approved"), "approved")
    assert d.approval_step(granted, "reject", "eve", 4) == (granted, "refused")  # decided once
    used, outcome = d.approval_step(granted, "use", "ann", 5)
    assert (used, outcome) == ((1, "ann", "used"), "used") and d.approval_step(used, "use", "ann", 6) == (used, "refused")  # used once
    assert d.approval_step(used, "request", "ann", 7) == ((7, "ann", "pending"), "opened")
    assert d.approval_step(d.approval_step(asked, "reject", "bob", 8)[0], "use", "ann", 9)[1] == "refused"


def test_approvals_in_batch_and_stream_alike(spark, sf_dir):
    steps = sorted(((r.key, r["at"], r.event, r.kind, r.actor) for r in decision_plans._steps(spark, sf_dir).collect()))
    state, true = {}, {}
    for key, _, event, kind, actor in steps:
        state[key], outcome = d.approval_step(state.get(key, (None, None, None)), kind, actor, event)
        true[event] = (key, outcome, state[key][0], state[key][2])
    for name in ("approval_outcomes", "stream_approvals"):
        got = {r.event: (r.key, r.outcome, r.approval, r.status) for r in QUERIES[name](spark, sf_dir).collect()}
        assert got == true
    assert {x[1] for x in true.values()} >= {"opened", "reused", "approved", "rejected", "refused", "used"}


def test_stream_of_approvals_in_several_batches(spark, tmp_path):
    from plumbline.streaming import states

    batches = [[("k", 5, 1, "request", "ann")], [("k", 9, 3, "use", "ann"), ("k", 7, 2, "approve", "bob")], [("k", 6, 4, "reject", "bob"), ("j", 1, 5, "request", "x")]]
    schema = "key string, at long, event long, kind string, actor string"
    out = []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = states.approval_stream(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, _: out.extend(df.collect()))
    for batch in batches:  # each run takes up the state of the one before
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.trigger(availableNow=True).start().awaitTermination()
    assert {r.event: r.outcome for r in out} == {1: "opened", 2: "approved", 3: "used", 4: "refused", 5: "opened"}


# Attribution.


def plain_norm(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return " " + " ".join(re.findall("[a-z0-9]+", plain)) + " "


def plain_mentions(text, catalog):
    """Products named in a text, line by line."""
    found = set()
    for line in text.split("\n"):
        nl, named = plain_norm(line), []
        for p in catalog:
            by_name = plain_norm(p["name"]).strip() and plain_norm(p["name"]) in nl and (not plain_norm(p["brand"]).strip() or plain_norm(p["brand"]) in nl)
            if by_name or any(plain_norm(a).strip() and plain_norm(a) in nl for a in p["aliases"]):
                named.append(p)
        hosts = {h.lower().removeprefix("www.") for h in re.findall(matching.HOST, line)}
        same = defaultdict(list)
        for p in named:
            same[plain_norm(p["brand"]), plain_norm(p["name"])].append(p)
        for group in same.values():
            if len(group) > 1 and any(p["site"] in hosts for p in group):
                group = [p for p in group if p["site"] in hosts]
            if len(group) == 1:
                found.add(group[0]["product_id"])
    for url in re.findall(matching.URL, text):
        key = re.sub(r"^https?://(www\.)?", "", url.rstrip(".,;:!?").lower()).rstrip("/")
        found |= {p["product_id"] for p in catalog if re.sub(r"^https?://(www\.)?", "", p["url"].lower()).rstrip("/") == key}
    return found


def plain_attribution(text, catalog):
    whole = plain_mentions(text, catalog)
    keys = {(plain_norm(p["brand"]), plain_norm(p["name"])) for p in catalog if p["product_id"] in whole}
    subset, current = [p for p in catalog if (plain_norm(p["brand"]), plain_norm(p["name"])) in keys], None
    for i, line in enumerate(text.split("\n")):
        if not line.strip(" "):
            current = None
            continue
        item = re.match(matching.LIST_ITEM, line)
        if item:
            current, line = None, item.group(1)
        for j, sentence in enumerate(re.split(r"(?<=[.!?])\s+", line)):
            named = plain_mentions(sentence, subset)
            if named:
                current = next(iter(named)) if len(named) == 1 else None
            if current is not None:
                yield i, j, sentence.strip(" "), current


def test_sentences_of_all_answers_equal_a_walk(spark, sf_dir):
    answers = {r.l_orderkey: r.text for r in answer_plans._answers(spark, sf_dir, answer_plans.SPOKEN).collect()}
    catalog = [r.asDict() for r in answer_plans._catalog(spark, sf_dir).collect()]
    got = defaultdict(list)
    for r in QUERIES["attributed_sentences"](spark, sf_dir).collect():
        got[r.l_orderkey].append((r.line_no, r.sentence_no, r.sentence, r.product_id))
    for key in sorted(answers)[::3]:
        assert sorted(got.get(key, [])) == list(plain_attribution(answers[key], catalog)), answers[key]


def test_sentences_of_awkward_answers(spark):
    catalog = [(1, "Acme", "Cloud Tee", "https://acme.example/a", "acme.example", []), (2, "Acme", "Cloud Tee", "https://other.example/b", "other.example", []), (3, "Nord", "Rain Tee", "", "nord.example", ["Rainy"])]
    texts = [
        None, "", "Nothing here. At all.", "The Rainy. It is nice! Really?\nStill it.\n\nNot it.", "Rainy and the Acme Cloud Tee at acme.example. Whose?", "Acme Cloud Tee. Unclear.\nAcme Cloud Tee at other.example. Clear.",
        "1. Rainy. Good.\n2) Other thing. Bad.\n- Rain Tee by Nord", "See https://acme.example/a. Good.",
    ]
    products = spark.createDataFrame(catalog, "product_id long, brand string, name string, url string, site string, aliases array<string>")
    answers = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, sentence string")
    got = defaultdict(list)
    for r in matching.attributed_sentences(answers, products, "id", "text").collect():
        got[r.id].append((r.line_no, r.sentence_no, r.product_id))
    assert {k: sorted(v) for k, v in got.items()} == {3: [(0, 0, 3), (0, 1, 3), (0, 2, 3), (1, 0, 3)], 5: [(1, 0, 2), (1, 1, 2)], 6: [(0, 0, 3), (0, 1, 3), (2, 0, 3)], 7: [(0, 0, 1), (0, 1, 1)]}


def test_lines_meet_names_and_not_all_products_of_a_name(spark, monkeypatch):
    """Sixty products of one brand and name gave sixty rows a line that names them."""
    catalog = [(i, "Acme", "Cloud Tee", "", f"s{i % 59}.example", ["Lone"] if i == 7 else ["Pair"] if i in (8, 9) else []) for i in range(60)] + [(99, "", "Cloud Tee", "", None, [])]
    products = spark.createDataFrame(catalog, "product_id long, brand string, name string, url string, site string, aliases array<string>")
    texts = ["Acme Cloud Tee", "Acme Cloud Tee at s1.example", "Acme Cloud Tee at s0.example", "Lone", "a Pair", "a Pair of s8.example", "Lone Acme Cloud Tee", "Acme Cloud Tee at s3.example and s4.example"]
    answers = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows, write = {}, matching.materialize

    def counting(df, label):
        out = write(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(matching, "materialize", counting)
    mentions, unmatched = matching.match_answers(answers, products, "id", "text")
    got = defaultdict(set)
    for r in mentions.collect():
        got[r.id].add(r.product_id)
    assert dict(got) == {0: {99}, 1: {1, 99}, 2: {99}, 3: {7}, 5: {8}, 6: {99}, 7: {99}}
    assert sorted(r.id for r in unmatched.where("kind = 'ambiguous'").collect()) == [0, 2, 4, 6, 7]
    assert rows["named"] <= 2 * len(texts)
