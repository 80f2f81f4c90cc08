"""Manifest, fill-in-the-middle and language models against plain Python, and on awkward rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import fim_boundaries, language_kn, merkle
from plumbline.storage import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, words string, form string, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def write(spark, tmp_path, rows):
    """A folder whose documents are ``rows`` of (doc_id, text, lang, source), with columns of clashing names."""
    full = [(*r, None if r[1] is None else len(r[1]), "x", "y", "z", "psm", 5) for r in rows]
    spark.createDataFrame(full, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def awkward(n=40):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abcXYZ é€𝄞\n") for _ in range(rng.randint(0, 60)))
    rows = [(i * 37, text(), "en", "hot") for i in range(n)]
    rows += [(-1, "Minus", "en", "hot"), (-(2**63), "least", "en", "hot"), (2**63 - 1, "MOST", "en", "hot"), (5, None, None, None), (6, "", "en", "")]
    rows += [(37, "Again", "de", "hot"), (37, "Again", "de", "hot"), (37, "other", "de", "hot"), (None, "no id", "en", "hot"), (None, "no id", "en", "hot"), (None, None, None, None)]
    rows += [(7, " \n\t", "en", "alone"), (8, "Ä" * 70_000, "de", "long"), (9, "x<P>y", "en", "long"), (10, "mixed Ä" * 30_000 + "𝄞" * 30_000, "fr", "long")]
    return rows


# Manifest.


def plain_manifest(docs, fanout=16):
    """The contract's rows, sorted, from (doc_id, text, lang, source, n_chars) tuples."""

    def record(doc_id, text, lang, source, n_chars):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def build(nodes):
        """(root, for each node the list of (before, after))."""
        paths, above, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, at in enumerate(above):
                run = level[at // fanout * fanout : at // fanout * fanout + fanout]
                paths[i].append(("".join(run[: at % fanout]), "".join(run[at % fanout + 1 :])))
                above[i] = at // fanout
            level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        return level[0], paths

    by = defaultdict(list)
    for row in docs:
        doc_id, text, lang, source, n_chars = row
        tampered = doc_id is not None and text is not None and zlib_crc(str(doc_id)) % 5 == 0
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if tampered else text
        by[source].append((doc_id, record(*row), record(doc_id, lower, lang, source, n_chars)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs.append(build([x[1] for x in by[s]]))
    root, upper = build([s[0] for s in subs])
    out = []
    for s, (subroot, paths), above in zip(sources, subs, upper, strict=True):
        for (doc_id, leaf, other), path in zip(by[s], paths, strict=True):
            h = other
            for before, after in path + above:
                h = sha(before + h + after)
            out.append((doc_id, leaf, subroot, root, sha("".join(b + a for b, a in path + above)), h, h == root))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def zlib_crc(text):
    import zlib

    return zlib.crc32(text.encode())


def test_manifest_awkward_equals_plain_python(spark, tmp_path):
    rows = awkward()
    sf_dir = write(spark, tmp_path, rows)
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, sf_dir).collect()]
    want = plain_manifest([(*r, None if r[1] is None else len(r[1])) for r in rows])
    assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) == want
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257])
def test_manifest_of_one_source(spark, n):
    leaves = spark.createDataFrame([("s", i * 3 - 20, sha(str(i)), f"k{i}") for i in range(n)], "tree string, doc_id long, leaf string, mine string")
    rows = {r.doc_id: r for r in merkle.manifest(leaves).withColumn("back", merkle.folded(F.col("leaf"), F.col("path"))).collect()}
    level = [sha(str(i)) for i in range(n)]
    while len(level) > 1:
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    assert len(rows) == n and {(r.subroot, r.root, r.back) for r in rows.values()} == {(level[0],) * 3}
    assert all(r.mine == f"k{(i + 20) // 3}" for i, r in rows.items())


def test_manifest_of_many_sources_and_other_fanout(spark):
    leaves = spark.createDataFrame([(f"s{i % 90}", i // 90, sha(str(i))) for i in range(500)], "tree string, doc_id long, leaf string")
    rows = merkle.manifest(leaves, fanout=3).withColumn("back", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert len(rows) == 500 and len({r.root for r in rows}) == 1 and all(r.back == r.root for r in rows)
    assert len({(r.tree, r.subroot) for r in rows}) == 90


def test_ranks_count_the_rows_before(spark):
    rng = random.Random(3)
    ids = [rng.randint(-9000, 9000) for _ in range(3000)] + [None] * 5 + [44] * 300
    leaves = spark.createDataFrame([("sx", i, sha(f"{k}")) for k, i in enumerate(ids)], "tree string, doc_id long, leaf string")
    rows, largest = merkle.placed(leaves)
    got = sorted((r.pos, r.doc_id, r.leaf) for r in rows.collect())
    order = sorted(((i is not None, i or 0, sha(f"{k}"), i) for k, i in enumerate(ids)))
    assert largest == len(ids) and got == [(p, i, h) for p, (_, _, h, i) in enumerate(order)]


def test_bitmaps_leave_out_empty_words(spark):
    ids = spark.createDataFrame([("s", 0, 3), ("s", 0, 63), ("s", 63, 0), ("s", 63, 0), ("s", 64, 1)], "tree string, word long, bit int")
    rows = {r.chunk: r for r in merkle.bitmaps(ids).collect()}
    assert [(w.word, w.bits, w.before, [tuple(x) for x in w.extras]) for w in rows[0].words] == [(0, (1 << 3) - (1 << 63), 0, []), (63, 1, 2, [(0, 1)])]
    assert (rows[0].first, rows[1].first, rows[1].n, rows[1].total) == (0, 4, 1, 5)


def test_manifest_empty(spark, tmp_path):
    sf_dir = write(spark, tmp_path, [])
    df = merkle.op11_merkle_manifest(spark, sf_dir)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and df.count() == 0


# Fill-in-the-middle.


def texts_of_all_kinds():
    rng = random.Random(9)
    yield from ("", "a", "é", "𝄞", "abc" * 50_000, "é" * 80_000, "𝄞" * 40_000, "x" * 65_535 + "é" + "y" * 65_536)
    for letters in ("ab", "aé", "a€𝄞", "é€𝄞"):
        for n in (5, 300, 70_000):
            yield "".join(rng.choice(letters) for _ in range(n))


def test_boundaries_select_as_a_walk_does():
    for text in texts_of_all_kinds():
        data = text.encode()
        found = fim_boundaries.Boundaries(np.frombuffer(data, np.uint8))
        offsets = [0, *np.cumsum([len(c.encode()) for c in text]).tolist()]
        assert len(found) == len(text) + 1
        for k in {0, 1, len(text) // 3, len(text) // 2, len(text) - 1, len(text), *random.Random(1).choices(range(len(text) + 1), k=200)}:
            if 0 <= k <= len(text):
                assert found.select(k) == offsets[k]


def test_containers_take_their_smallest_form():
    values = lambda *r: np.array(sorted({x for a in r for x in a}))
    rng = np.random.default_rng(1)
    for offsets, kind in (
        (values(range(65_536)), fim_boundaries.Runs), (values(range(0, 4000, 2)), fim_boundaries.Array), (values(range(0, 65_536, 3)), fim_boundaries.Bitmap),
        (values([65_535]), fim_boundaries.Array), (values(range(10), range(50, 90)), fim_boundaries.Runs), (np.flatnonzero(rng.random(65_536) < 0.4), fim_boundaries.Bitmap),
    ):
        found = fim_boundaries.container(offsets)
        assert type(found) is kind
        assert [found.select(k) for k in range(0, len(offsets), 7)] == offsets[::7].tolist()


def test_cuts_equal_plain_python(spark, tmp_path):
    rows = awkward()
    sf_dir = write(spark, tmp_path, rows)
    got = fim_boundaries.op12_fill_in_middle(spark, sf_dir).collect()

    def cut(doc_id, text):
        text, n = text or "", len(text or "")
        h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = text[:a], text[a:b], text[b:]
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            return doc_id, n, "plain", None, None, sha(text), sha(text)
        if h[3] % 100 < 20:
            return doc_id, n, "spm", a, b - a, sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
        return doc_id, n, "psm", a, b - a, sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)

    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted((cut(r[0], r[1]) for r in rows), key=order)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    cuts = fim_boundaries.fill_in_middle(table(spark, sf_dir, "documents"))
    for r in cuts.where("form = 'psm'").collect():
        prefix = r.output.removeprefix("<P>").encode()[: r.prefix_bytes].decode()
        assert len(prefix) == r.prefix_chars and r.output.encode().endswith(b"<M>" + (r.output.encode()[len(r.output.encode()) - r.middle_bytes :]))


def test_cuts_of_marks_that_touch(spark):
    """Text that ends or begins like a mark at a cut comes back."""
    rows = [(i, x * 3) for i, x in enumerate(["<P", "<", "S>", "<<M", "P><", ">"] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = fim_boundaries.fill_in_middle(docs, plain_percent=0).withColumn("back", fim_boundaries.restored(F.col("output"), F.col("form")))
    assert {r.doc_id: r.back for r in cut.collect()} == {i: t for i, t in rows}


def test_cuts_empty(spark, tmp_path):
    assert fim_boundaries.op12_fill_in_middle(spark, write(spark, tmp_path, [])).count() == 0


# Language models.


def plain_codes(text):
    letters = "".join(c.lower()[0] if c.isalpha() and ord(c) < language_kn.LAST_LETTER else " " for c in text)
    words = letters.split()
    return " ".join(words) + " " if words else ""


class PlainModel:
    """Interpolated Kneser-Ney over whole strings, from the formulas."""

    def __init__(self, texts, alphabet):
        top = Counter()
        for text in texts:
            padded = "\0\0\0" + plain_codes(text)
            for i in range(3, len(padded)):
                top[padded[i - 3 : i + 1]] += 1
        self.alphabet, self.counts = alphabet, {4: top}
        for k in (3, 2, 1):
            self.counts[k] = Counter(x[1:] for x in self.counts[k + 1])
        self.discount, self.total, self.types = {}, {}, {}
        for k, counts in self.counts.items():
            ones, twos = (sum(v == c for v in counts.values()) for c in (1, 2))
            self.discount[k] = ones / (ones + 2 * twos) if ones and twos else 0.5
            self.total[k], self.types[k] = Counter(), Counter()
            for x, v in counts.items():
                self.total[k][x[:-1]] += v
                self.types[k][x[:-1]] += 1

    def p(self, x):
        k = len(x)
        below = 1 / self.alphabet if k == 1 else self.p(x[1:])
        if not self.total[k][x[:-1]]:
            return below
        d = self.discount[k]
        gamma = d * self.types[k][x[:-1]] / self.total[k][x[:-1]]
        return max(self.counts[k][x] - d, 0) / self.total[k][x[:-1]] + gamma * below

    def bits(self, text):
        padded = "\0\0\0" + plain_codes(text)
        return -sum(math.log2(self.p(padded[i - 3 : i + 1])) for i in range(3, len(padded))) / (len(padded) - 3)


@pytest.fixture
def fixture_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()
    return [(r.doc_id, r.text, r.lang) for r in rows]


def test_bits_equal_plain_kneser_ney(spark, fixture_texts, monkeypatch):
    monkeypatch.setattr(language_kn, "CALIBRATION_MIN", 10**9)
    train, other = fixture_texts[:60], fixture_texts[60:80]
    model = language_kn.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    alphabet = len({c for _, t, _ in train for c in plain_codes(t)}) + 1
    plain = {x: PlainModel([t for _, t, lang in train if lang == x], alphabet) for x in model.languages}
    texts = [t for _, t, _ in other if plain_codes(t)] + ["Ünseen ﬁ 漢字 text", "x", "!a? b."]
    n, bits = model.bits(pa.array(texts))
    assert n.tolist() == [len(plain_codes(t)) for t in texts]
    for i, text in enumerate(texts):
        assert bits[i] == pytest.approx([plain[x].bits(text) for x in model.languages], abs=1e-9)


def test_probabilities_of_a_context_sum_to_one(spark, fixture_texts, monkeypatch):
    monkeypatch.setattr(language_kn, "CALIBRATION_MIN", 10**9)
    train = fixture_texts[:40]
    alphabet = sorted({c for _, t, _ in train for c in plain_codes(t)})
    model = language_kn.fit(spark.createDataFrame([(i, t, "all") for i, t, _ in train], "doc_id long, text string, lang string"))
    for context in ("\0\0\0", "\0\0t", "the", "qqq", "e t"):
        sequences = np.array([[ord(c) for c in context + x] for x in [*alphabet, "漢"]], np.uint32)
        upto, before = language_kn._hashes(sequences.ravel(), np.arange(3, sequences.size, 4))
        assert np.exp2(model.log2(0, upto, before)).sum() == pytest.approx(1, abs=1e-9)


def test_long_texts_in_pieces_need_the_same_bits(spark, fixture_texts, monkeypatch):
    model = language_kn.fit(spark.createDataFrame(fixture_texts[:60], "doc_id long, text string, lang string"))
    texts = pa.array([fixture_texts[70][1] * 3, "", "ab", "  .  " * 40 + "one  two" + "  .  " * 40, None, fixture_texts[71][1]])
    whole = model.bits(texts)
    monkeypatch.setattr(language_kn, "CHUNK_CHARS", 7)
    pieces = model.bits(texts)
    assert whole[0].tolist() == pieces[0].tolist() and np.allclose(whole[1], pieces[1], atol=1e-9)


def test_rare_sequences_go_when_models_are_bounded(spark, fixture_texts):
    counts = language_kn.count_sequences(spark.createDataFrame([(i, t, len(x) % 3) for i, t, x in fixture_texts[:40]], "doc_id long, text string, lang int"))
    n = sorted((r.n for r in counts.collect()), reverse=True)
    for bound in (0, 50, 500, len(n)):
        kept = [r.n for r in language_kn.bounded_counts(counts, bound).collect()]
        assert len(kept) <= bound and sorted(kept, reverse=True) == n[: len(kept)] and (len(kept) == len(n) or n[len(kept)] not in kept)


def test_models_in_blocks_predict_as_whole_ones_do(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(language_kn, "CALIBRATION_MIN", 10)
    docs = table(spark, sf_dir, "documents").limit(100).union(spark.createDataFrame([(1000 + i, x, "xx" if i < 4 else "yy", "s", 1) for i, x in enumerate(["漢字 ж", "", None, "qzv qzv", "!"])], table(spark, sf_dir, "documents").schema))
    whole = language_kn.fit(docs)
    expected = {(r.doc_id): r for r in language_kn.predict(docs, whole).collect()}
    for bounds in ((1500, 500), (10**6, 2)):
        model = language_kn.fit(docs, *bounds)
        assert isinstance(model, language_kn.BlockedModel) and sum(model.parts.values()) > 2
        assert model.languages == whole.languages and model.sharpness == pytest.approx(whole.sharpness)
        found = language_kn.predict(docs, model).collect()
        assert len(found) == len(expected)
        for r in found:
            e = expected[r.doc_id]
            assert (r.lang_pred, r.rejected, r.n) == (e.lang_pred, e.rejected, e.n) and r.score == pytest.approx(e.score, abs=1e-6) and r.bits == pytest.approx(e.bits, abs=1e-9)


@pytest.mark.parametrize("bounds", [(), (20, 500)])
def test_texts_left_out_for_calibration_are_counted_in_the_end(spark, monkeypatch, bounds):
    monkeypatch.setattr(language_kn, "CALIBRATION_MIN", 10)
    texts = [f"{chr(0x4E00 + i)}{chr(0x5000 + i)} word" for i in range(160)]  # each has sequences that no other has
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_kn.fit(docs, *bounds)
    expected = PlainModel(texts, 1).counts[4]
    found = model.addends.where("kind = 'p4'").count() if bounds else len(model.arrays[0, "p4"][0])
    assert found == len(expected) and model.usual.keys() == {0}


def test_all_texts_left_out_calibrate(spark):
    rng = np.random.default_rng(5)
    truth, n = rng.integers(0, 2, 9000), rng.integers(1, 300, 9000)
    bits = 3 + 0.1 * rng.standard_normal((9000, 2))
    bits[np.arange(9000), truth] -= 0.1
    bits[:40] += 4
    rows = spark.createDataFrame([(int(t), int(m), b.tolist()) for t, m, b in zip(truth, n, bits, strict=True)], "truth int, n long, all_bits array<double>").repartition(7)
    sharpness, usual = language_kn.calibration(rows)
    assert sharpness == language_kn.calibrated(language_kn.Model(["a", "b"], {}), truth, n, bits).sharpness
    scaled = []
    for lang in (0, 1):
        own = (bits.argmin(axis=1) == truth) & (truth == lang)
        x, m = bits[own, lang], n[own]
        mean = np.average(x, weights=m)
        spread = np.sqrt(np.mean((x - mean) ** 2 * m))
        scaled.append((x - mean) * np.sqrt(m) / spread)
        assert usual[lang][:2] == pytest.approx((mean, spread), rel=1e-9)
    assert usual[0][2] == usual[1][2] == pytest.approx(np.quantile(np.maximum(np.concatenate(scaled), language_kn.LEAST_CUT), 1 - language_kn.REJECTED_SHARE))


def test_languages_of_held_out_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language_kn.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 0.2 < len(held) / len(rows) < 0.3
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in held) / len(held) < 0.05


def test_texts_of_no_language_are_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_kn.fit(docs)
    rng = random.Random(2)
    noise = ["".join(rng.choice("qwxzjkvy ") for _ in range(300)), "漢字" * 100]
    rows = language_kn.predict(spark.createDataFrame(enumerate(noise), "doc_id long, text string"), model).collect()
    assert all(r.rejected and r.lang_pred in model.languages for r in rows)


def test_calibration_finds_the_likeliest_sharpness():
    rng = np.random.default_rng(4)
    truth, n = rng.integers(0, 2, 2000), np.full(2000, 100.0)
    bits = np.full((2000, 2), 3.0)
    bits[np.arange(2000), truth] -= 0.02 + 0.05 * rng.standard_normal(2000)
    model = language_kn.calibrated(language_kn.Model(["a", "b"], {}), truth, n, bits)
    best, score, _, _ = model.choose(n, bits)
    assert abs((best == truth).mean() - score.mean()) < 0.03 and 0.55 < score.mean() < 0.95


def test_languages_awkward(spark, tmp_path):
    rows = awkward()
    out = language_kn.op13_language_kneser_ney(spark, write(spark, tmp_path, rows)).collect()
    assert len(out) == len(rows)
    for r, text in ((r, {None: 0, **{x[0]: x[1] for x in rows}}[r.doc_id]) for r in out if r.doc_id not in (37, None)):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r.score <= 1
    assert {r.lang_pred for r in out} <= {"en", "de", "fr", "und"}
    assert {r.lang_pred for r in out if r.doc_id is None} == {"en", "und"} and {r.held_out for r in out if r.doc_id is None} == {False}


def test_languages_without_labels_or_rows(spark, tmp_path):
    none = language_kn.op13_language_kneser_ney(spark, write(spark, tmp_path / "a", [(i, "some text", None, "s") for i in range(9)])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)} and len(none) == 9
    assert language_kn.op13_language_kneser_ney(spark, write(spark, tmp_path / "b", [])).count() == 0
    one = language_kn.op13_language_kneser_ney(spark, write(spark, tmp_path / "c", [(i, "some text", "en", "s") for i in range(9)])).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0)}
