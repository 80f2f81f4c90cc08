"""Fill-in-the-middle transformation: two cuts between code points, found in a compressed set of their byte offsets.

A text's code points begin at byte offsets that form its boundary set. The set is kept in containers of 65,536 offsets,
each as a sorted array, a bitmap with the counts before its words, or runs with the counts before them, whichever is
smallest, and the cardinalities of the containers are summed up. The k-th boundary is found by a search for its container and
a select inside; so a cut costs no walk over the text, and the pieces are slices of its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.storage import table

#: Marks before prefix, suffix and middle; texts that hold one of them stay as they are.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many stay plain; of a hundred cut ones so many have the suffix first.
PLAIN_PERCENT = 10
SUFFIX_FIRST_PERCENT = 20
SEED = 1
#: Offsets of a container, and the bytes that its forms take: an array's offset, a whole bitmap, a run.
SPAN = 1 << 16
ARRAY_BYTES, BITMAP_BYTES, RUN_BYTES = 2, SPAN // 8, 4
#: Bytes of text in a batch of results.
BATCH_BYTES = 8 << 20


class Array:
    """Sorted offsets."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class Runs:
    """Runs of consecutive offsets, with the number of offsets before each."""

    def __init__(self, values: np.ndarray, breaks: np.ndarray):
        first = np.concatenate([[0], breaks + 1])
        self.starts, self.before = values[first].astype(np.uint16), first.astype(np.uint32)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


class Bitmap:
    """A bit an offset in words of 64, with the number of bits before each word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.uint32)
        self.before = np.cumsum(counts, dtype=np.uint32) - counts

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        left = int(self.words[word])
        for _ in range(k - int(self.before[word])):
            left &= left - 1
        return 64 * word + (left & -left).bit_length() - 1


def container(values: np.ndarray) -> Array | Runs | Bitmap:
    """The smallest form of the sorted, distinct offsets ``values`` (below SPAN, at least one)."""
    breaks = np.flatnonzero(np.diff(values) != 1)
    array, runs = ARRAY_BYTES * len(values), RUN_BYTES * (len(breaks) + 1)
    if runs <= min(array, BITMAP_BYTES):
        return Runs(values, breaks)
    return Array(values) if array <= BITMAP_BYTES else Bitmap(values)


class Boundaries:
    """The offsets where the code points of UTF-8 ``data`` begin, and its end as the last."""

    def __init__(self, data: np.ndarray):
        self.high, self.containers, counts = [], [], []
        for high in range(len(data) // SPAN + 1):
            part = data[high * SPAN : (high + 1) * SPAN]
            begins = np.flatnonzero((part & 0xC0) != 0x80)
            if high == len(data) // SPAN:
                begins = np.append(begins, len(part))
            if len(begins):
                self.high.append(high)
                self.containers.append(container(begins))
                counts.append(len(begins))
        self.upto = np.cumsum(counts)

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, k: int) -> int:
        """The k-th boundary, from 0."""
        at = int(np.searchsorted(self.upto, k, side="right"))
        return self.high[at] * SPAN + self.containers[at].select(k - int(self.upto[at - 1]) if at else k)


def _cut(text: bytes, first: int, second: int, form: str) -> tuple:
    """(n, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output)."""
    boundaries = Boundaries(np.frombuffer(text, np.uint8))
    n = len(boundaries) - 1
    if form == "plain":
        return n, None, None, None, None, text
    a, b = sorted((first % (n + 1), second % (n + 1)))
    i, j = boundaries.select(a), boundaries.select(b)
    p, s, m = (x.encode() for x in MARKS)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    output = p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle
    return n, a, b - a, i, j - i, output


def _cut_batches(batches):
    for batch in batches:
        ids, texts, first, second, forms = batch.columns
        at = 0
        while at < batch.num_rows:
            rows, held, begin = [], 0, at
            while at < batch.num_rows and (held < BATCH_BYTES or not rows):
                text = texts[at].as_buffer()
                rows.append(_cut(text.to_pybytes() if text else b"", first[at].as_py(), second[at].as_py(), forms[at].as_py()))
                held += len(rows[-1][-1])
                at += 1
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(begin, at - begin), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary()).cast(pa.string()), forms.slice(begin, at - begin)],
                names=["doc_id", "n", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output", "form"],
            )


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output) for every row of ``docs``.

    The digest of seed and doc_id decides cuts and form, so a document is cut alike in every run. A null text counts as empty
    and, as an empty one, stays plain; so do texts that hold a mark. A null doc_id is hashed as no digits; rows that repeat a
    doc_id are cut by the same two numbers. Cuts are null where the form is plain. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (h[2] % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first_percent, "spm").otherwise("psm")
    rows = docs.select(id_.alias("doc_id"), text.alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    schema = "doc_id long, n long, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string, form string"
    cut = rows.mapInArrow(_cut_batches, schema)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output")


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its marks are the only ones in it, as texts that hold one stay plain."""
    parts = F.split(output, "|".join(MARKS), -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    back = F.when(form == "plain", output)
    for name, places in order.items():
        back = back.when(form == name, F.concat(*(F.get(parts, F.lit(i)) for i in places)))
    return back


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` cut, with digests of the output and of the text rebuilt from it."""
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


OP12_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    k AS (SELECT *, length(t) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::UBIGINT::BIGINT) AS hs FROM t),
    f AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 90 THEN 'plain' WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
    p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
