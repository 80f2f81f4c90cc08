"""Byte-level BPE by a minimal acyclic transducer of frequent words, with exact merging of all other words.

The frequent words of the corpus (counted over all of it) are merged once and compiled into a minimal acyclic automaton:
equal suffixes share states, and outputs on the transitions add up to a word's rank, which selects its token ids. The
automaton is sent to the executors as one file and memory-mapped there, so that all workers of a machine share its pages.
Tasks split whole texts into words, look the distinct words of a batch up in the automaton, merge the words that it
lacks, and lay out ids text by text.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.storage import materialize, table

#: Frequent words that the lexicon holds at most, and the times that a word must occur to be one.
LEXICON_WORDS = 50_000
MIN_COUNT = 2
LONGEST_WORD = 64
#: Characters of text that a task works on at a time; distinct words that a worker remembers.
CHUNK_CHARS = 2_000_000
MEMORY_WORDS = 150_000
#: How the tokenizer's pre-tokenizer splits text (a fixed value of the vocabulary file's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    """The tokenizer file of the contract; any other of the same kind can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(spare)}


class Vocabulary:
    """Merges and ids of a byte-level BPE file, and the special tokens that are matched in the text itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = _byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.id_of = {spell(s): i for s, i in data["model"]["vocab"].items() if all(c in letters for c in s)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        self.rank = {(self.id_of[spell(a)], self.id_of[spell(b)]): i for i, (a, b) in enumerate(pairs)}
        self.merged = {(a, b): self.id_of[self._bytes(a) + self._bytes(b)] for a, b in self.rank}
        self.by_rank = list(self.merged.values())
        self.first = [self.id_of[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}

    def _bytes(self, i: int) -> bytes:
        if not hasattr(self, "_spelling"):
            self._spelling = {i: s for s, i in self.id_of.items()}
        return self._spelling[i]

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens in id order, and their offsets."""
        spelling = {i: s for s, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        parts = [spelling.get(i, b"") for i in range(max(spelling) + 1)]
        ends = np.cumsum([0, *map(len, parts)])
        return np.frombuffer(b"".join(parts), np.uint8), ends

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the leftmost adjacent pair of least rank is merged until none has a rank."""
        ids = [self.first[b] for b in word]
        if len(ids) > 256:
            return self._merge_long(ids)
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i : i + 2] = [self.by_rank[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps, by a heap of pairs over a linked list."""
        import heapq

        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        alive = [True] * n
        heap = [(self.rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.merged[a, b], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (p := (ids[x], ids[y])) in self.rank:
                    heapq.heappush(heap, (self.rank[p], x, *p))
        return [x for x, live in zip(ids, alive, strict=True) if live]


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of ``words`` with their ids as arrays.

    ``key`` holds source state * 256 + byte of every transition in order, ``target`` its end, ``output`` what the
    transition adds to the rank, ``final`` the states that end a word; ids of rank r are flat[first[r]:first[r + 1]].
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def freeze(node) -> int:
        signature = (node[0], tuple(node[1]))
        if signature not in register:
            register[signature] = len(states)
            states.append(signature)
        return register[signature]

    path: list[list] = [[False, []]]  # [is final, [(byte, state), ...]] along the last word
    last = b""
    for i in order:
        word = words[i]
        same = len(os.path.commonprefix([last, word]))
        while len(path) > same + 1:
            child = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], child))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        child = freeze(path.pop())
        path[-1][1].append((last[len(path) - 1], child))
    start = freeze(path[0])
    below = [0] * len(states)  # words that end at or below a state; children were frozen first
    key, target, output = [], [], []
    for s, (final, edges) in enumerate(states):
        count = int(final)
        for byte, child in edges:
            key.append(s * 256 + byte)
            target.append(child)
            output.append(count)
            count += below[child]
        below[s] = count
    first = np.cumsum([0, *(len(ids[i]) for i in order)])
    return {
        "key": np.array(key, np.int64),
        "target": np.array(target, np.int64),
        "output": np.array(output, np.int64),
        "final": np.array([f for f, _ in states], np.bool_),
        "start": np.array([start], np.int64),
        "first": first.astype(np.int64),
        "flat": np.array([x for i in order for x in ids[i]], np.uint32),
    }


class Lexicon:
    """A compiled lexicon, read through a memory map."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            size = int.from_bytes(file.read(8), "little")
            parts = json.loads(file.read(size))
        for name, (kind, offset, length) in parts.items():
            value = np.memmap(path, kind, "r", 8 + size + offset, (length,)) if length else np.zeros(0, kind)
            setattr(self, name, np.asarray(value))  # a plain view of the map

    @staticmethod
    def save(arrays: dict[str, np.ndarray], path: str) -> None:
        parts, offset = {}, 0
        for name, value in arrays.items():
            parts[name] = (value.dtype.str, offset, len(value))
            offset += value.nbytes
        head = json.dumps(parts).encode()
        with open(path, "wb") as file:
            file.write(len(head).to_bytes(8, "little") + head)
            for value in arrays.values():
                file.write(value.tobytes())

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for those that the lexicon lacks; all words step through it together."""
        found = np.full(len(words), -1, np.int64)
        if not len(self.key) or not words:
            return found
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        live = np.flatnonzero((lengths > 0) & (lengths <= LONGEST_WORD))
        state = np.full(len(live), self.start[0])
        rank = np.zeros(len(live), np.int64)
        depth = 0
        while len(live):
            wanted = state * 256 + text[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            on = self.key[at] == wanted
            live, at = live[on], at[on]
            state, rank = self.target[at], rank[on] + self.output[at]
            depth += 1
            ended = lengths[live] == depth
            good = ended & self.final[state]
            found[live[good]] = rank[good]
            live, state, rank = live[~ended], state[~ended], rank[~ended]
        return found


@lru_cache(maxsize=2)
def _loaded(tokenizer: str, lexicon: str):
    import regex

    vocabulary = Vocabulary(tokenizer)
    split = regex.compile(PATTERN).findall
    special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) or r"(?!)")
    return vocabulary, Lexicon(SparkFiles.get(lexicon)), split, special, vocabulary.token_bytes(), {}


def _spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indexes first[i], ..., first[i] + length[i] - 1 for all i in turn."""
    ends = np.cumsum(length)
    return np.repeat(first - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def _encode(texts: list[str], loaded) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and where each text's begin (and the last one's end)."""
    vocabulary, lexicon, split, special, _, memory = loaded
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        before = len(words)
        at = 0
        for m in special.finditer(text) if "<" in text or len(vocabulary.special) > 1 else ():
            words += split(text[at : m.start()])
            words.append("\0" + m.group())  # no word of the pattern mixes a control character with letters
            at = m.end()
        words += split(text[at:] if at else text)
        counts[i] = len(words) - before
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    del words
    ids: list = [memory.get(w) for w in distinct]
    new = [i for i, x in enumerate(ids) if x is None]
    spelled = [distinct[i].encode() for i in new]
    ranks = lexicon.ranks(spelled)
    if len(memory) + len(new) > MEMORY_WORDS:
        memory.clear()
    for i, word, rank in zip(new, spelled, ranks.tolist(), strict=True):
        if rank >= 0:
            ids[i] = lexicon.flat[lexicon.first[rank] : lexicon.first[rank + 1]].tolist()
        elif word[:1] == b"\0" and word[1:].decode() in vocabulary.special:
            ids[i] = [vocabulary.special[word[1:].decode()]]
        else:
            ids[i] = vocabulary.merge(word)
        if len(memory) < MEMORY_WORDS and len(word) <= LONGEST_WORD:
            memory[distinct[i]] = ids[i]
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((x for y in ids for x in y), np.uint32, int(length.sum()))
    first = np.cumsum(length) - length
    out = flat[_spans(first[codes], length[codes])] if len(codes) else np.zeros(0, np.uint32)
    words_end = np.concatenate([[0], np.cumsum(length[codes])]) if len(codes) else np.zeros(1, np.int64)
    return out, words_end[np.concatenate([[0], np.cumsum(counts)])]


def _decode(ids: np.ndarray, table_bytes: tuple[np.ndarray, np.ndarray]) -> bytes:
    data, ends = table_bytes
    return data[_spans(ends[ids], ends[ids.astype(np.int64) + 1] - ends[ids])].tobytes()


def _encode_batches(batches, tokenizer: str, lexicon: str, with_ids: bool):
    loaded = _loaded(tokenizer, lexicon)
    for batch in batches:
        keys, column = batch.column(0), batch.column(1)
        first = 0
        while first < batch.num_rows:
            texts, held = [], 0
            while first + len(texts) < batch.num_rows and (held < CHUNK_CHARS or not texts):
                texts.append(column[first + len(texts)].as_py() or "")
                held += len(texts[-1])
            ids, ends = _encode(texts, loaded)
            sums, back, lists = [], [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                own = ids[a:b]
                sums.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                plain = _decode(own, loaded[4])
                back.append(hashlib.sha256(plain.decode("utf-8", "replace").encode()).hexdigest())
            columns = [keys.slice(first, len(texts)), pa.array(np.diff(ends), pa.int64()), pa.array(sums), pa.array(back)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
                columns.append(lists)
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
            first += len(texts)


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the commonest runs of letters with the blank before them, as the tokenizer splits them, over all texts."""
    found = F.regexp_extract_all(F.col("text"), F.lit(r" ?\p{L}+"), F.lit(0))
    counted = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = materialize(
        counted.where((F.col("n") >= min_count) & (F.octet_length("word") <= LONGEST_WORD)), "frequent-words"
    )
    # Counts by the logarithm's eighths show which count still fits, so the driver gets no more than the lexicon.
    level = F.floor(F.log2("n") * 8)
    fitting, least = 0, None
    for at, n in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        fitting += n
        if fitting > words:
            break
        least = at
    return counted.where(F.lit(False) if least is None else level >= least)


def encode(docs: DataFrame, tokenizer: str | None = None, lexicon_words: int = LEXICON_WORDS, with_ids: bool = False):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``, and ids on request.

    Ids are those of the tokenizer file's own library without added special tokens: special tokens found in the text
    itself keep their ids. Null texts count as empty; an empty text has no ids and the digests of nothing; null and
    repeated doc_ids are ordinary rows. Other columns of ``docs`` are ignored.
    """
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = Vocabulary(tokenizer)
    words = [r["word"].encode() for r in frequent_words(texts, lexicon_words).collect()]
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = os.path.realpath(tempfile.mkdtemp(prefix="lexicon-"))  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    Lexicon.save(compile_lexicon(words, [vocabulary.merge(w) for w in words]), os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return texts.mapInArrow(lambda b: _encode_batches(b, tokenizer, name, with_ids), schema)


def op7_bpe_lexicon(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` encoded and decoded."""
    return encode(table(spark, sf_dir, "documents"))
