"""BPE encoding and decoding with a tokenization automaton.

The automaton accepts exactly the token sequences that the merge rules can produce. It is compiled from
the merges in their order, one gadget per merge. Before the first merge one state lets every base symbol
follow every other. The gadget of a merge ``u v -> w`` changes three things:

* wherever ``u`` may follow, ``w`` may follow from now on;
* after ``w`` may come what may come after ``v`` at this moment (``w`` copies the state of ``v``);
* after ``u`` the symbol ``v`` may no longer come (the arc is cut).

A state is thus named by the last token, and the gadgets are three flat arrays (left part, right part,
time of birth) and one table of cut arcs: a persistent form of the copied states, linear in the number of
merges. A row of the transition table is read off the gadgets the first time it is needed and kept.

Encoding walks a pre-split word once: the state before each position is the last token of the word up to
there, and every accepted path is the merges' own result. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import Batches, column_values, with_columns

CACHE = 200_000  # distinct chunks, and words, that a task remembers; it keeps the last two such lots
ROWS = 1_000  # texts encoded at a time


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """Merges compiled to a deterministic automaton over tokens."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        size = max(vocab.values()) + 1
        self.vocab, self.suffix, self.size = vocab, suffix, size
        self.labels = [""] * size
        for label, t in vocab.items():
            self.labels[t] = label
        self.left, self.right, self.birth = array("i", [-1]) * size, array("i", [-1]) * size, array("i", [0]) * size
        self.cut: dict[int, int] = {}
        self.alive = bytearray(b"\1") * size
        self.table: dict[int, bool] = {}
        for time, (a, b) in enumerate(merges, 1):
            self._gadget(time, vocab[a], vocab[b], vocab[a + b])

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        if self.birth[w]:
            raise ValueError(f"two merges make {self.labels[w]!r}")
        reached = self.alive[u] and self.alive[v] and self._follows(u, v, time)
        self.left[w], self.right[w], self.birth[w], self.alive[w] = u, v, time, reached
        self.cut[u * self.size + v] = time

    def _follows(self, a: int, b: int, time: int) -> bool:
        """May ``b`` come after ``a`` once the gadgets before ``time`` are in place?"""
        left, right, birth, cut, size = self.left, self.right, self.birth, self.cut, self.size
        while True:
            if cut.get(a * size + b, time) < time:
                return False
            if birth[b] > birth[a]:  # b got its arcs where its left part had one
                if left[b] == right[b] == a:  # of equal neighbours the first two merge
                    return False
                time, b = birth[b], left[b]
            elif birth[a] > birth[b]:  # a copied the state of its right part
                time, a = birth[a], right[a]
            elif birth[a] == 0:
                return True
            else:
                time, a, b = birth[a], right[a], left[b]

    def step(self, state: int, token: int) -> bool:
        """Is there an arc from the state to the token? Filled in on first use."""
        key = state * self.size + token
        known = self.table.get(key)
        if known is None:
            known = self.table[key] = bool(self._follows(state, token, 1 << 30))
        return known

    def spelling(self) -> dict:
        """Labels as a tree: character -> [token inside a word, token that ends one, tree below]; -1 for none."""
        top: dict = {}
        for label, t in self.vocab.items():
            if not self.alive[t]:
                continue
            last = bool(self.suffix) and label.endswith(self.suffix)
            below = top
            for c in label[: len(label) - len(self.suffix)] if last else label:
                entry = below.setdefault(c, [-1, -1, {}])
                below = entry[2]
            entry[last if self.suffix else 0] = t
            if not self.suffix:
                entry[1] = t
        return top

    def encode(self, word: str, top: dict) -> list[int]:
        """Token ids of one pre-split word, given as base symbols: the one path through the automaton whose
        labels spell the word. Longer arcs are tried first. A state that is reached at a position is the
        same by whatever path, so a position without a way on is left for good."""
        last, size, known, step = len(word) - 1, self.size, self.table.get, self.step
        path, dead, at, state, fresh = [], set(), 0, -1, True
        while True:
            if fresh:
                arcs, below = [], top
                for j in range(at, last):
                    entry = below.get(word[j])
                    if entry is None:
                        break
                    t, _, below = entry
                    if t >= 0:
                        arcs.append((t, j + 1))
                else:
                    entry = below.get(word[last])
                    if entry is not None and entry[1] >= 0:
                        arcs.append((entry[1], last + 1))
            fresh = False
            while arcs:
                t, end = arcs.pop()
                if end in dead:
                    continue
                if state >= 0:
                    ok = known(state * size + t)
                    if not (step(state, t) if ok is None else ok):
                        continue
                path.append((at, state, arcs, t))
                if end > last:
                    return [p[3] for p in path]
                at, state, fresh = end, t, True
                break
            if not fresh:
                if not path:
                    raise ValueError(f"no path for {word!r}")
                dead.add(at)
                at, state, arcs, _ = path.pop()


class Tokenizer:
    """Normal form, pre-splitting and automaton of a tokenizer file of the kind "BPE with word ends"."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.labels = {i: x for x, i in (model["vocab"] | added).items()}
        self.added = added
        self.split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")

    def encoder(self) -> "Encoder":
        return Encoder(self)


class Encoder(dict):
    """Chunk (a run without white space) -> token ids; one per task, at most CACHE chunks at a time."""

    #: White space of the pre-splitting rule. Python's own split also takes U+001C to U+001F.
    SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
    ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.automaton, self.added = tokenizer.automaton, tokenizer.added
        self.find = regex.compile(tokenizer.split).findall
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.symbols = {b: ord(c) for b, c in byte_symbols().items()}
        self.spelling = self.automaton.spelling()
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # what was remembered before the last new start
        self.old_words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            base = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.symbols)
            ids = self.old_words.get(word)
            if ids is None:
                ids = array("i", self.automaton.encode(base, self.spelling)).tobytes() if base else b""
            if len(self.words) >= CACHE:
                self.words, self.old_words = {}, self.words
            self.words[word] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is not None:
            pass
        elif chunk.isascii():
            text = chunk.lower()
            if text.isalpha():
                ids = self.word(text)
            elif text[:-1].isalpha() and not text[-1].isalnum():
                ids = self.word(text[:-1]) + self.word(text[-1])
            else:
                ids = b"".join(map(self.word, self.find(text)))
        else:
            text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            ids = b"".join(map(self.word, self.find(text)))
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        if len(chunk) <= 200:
            self[chunk] = ids
        return ids

    def plain(self, text: str) -> bytes:
        chunks = [c for c in self.SPACE.split(text) if c] if self.ODD.search(text) else text.split()
        return b"".join(map(self.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as 32-bit numbers in a row. Added tokens are found first; the rest is split
        at white space, which no word of the pre-splitting rule crosses."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return b"".join(array("i", [self.added[p]]).tobytes() if p in self.added else self.plain(p) for p in self.special.split(text))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(spark: SparkSession, path: str | None = None):
    """Compile a tokenizer file and broadcast it: its size is that of the vocabulary, whatever the corpus."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(Tokenizer(path or default_path())))


def encode(docs: DataFrame, tokenizer, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` array<int>, the token ids of the whole text; a column of that name is replaced.
    A null or empty text, and one of white space only, has none. Rows stay where they are: no shuffle."""
    return _coded(docs, tokenizer, text, ids, None)


def _coded(docs: DataFrame, tokenizer, text: str, ids: str, decoded: str | None) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name not in (ids, text, decoded)]

    def run(batches: Batches) -> Batches:
        own = cloudpickle.loads(tokenizer.value)
        encoder, labels = own.encoder(), own.labels
        gc.disable()  # the caches hold no cycles, and walking them again and again is slow
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                flat = [encoder.encode(t) if t else b"" for t in column_values(part, "__text")]
                offsets = np.concatenate(([0], np.cumsum([len(f) // 4 for f in flat]))).astype(np.int32)
                new = {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(flat), np.int32)))}
                if decoded:
                    new[decoded] = pa.array([emit(np.frombuffer(f, np.int32).tolist(), labels) for f in flat], pa.string())
                yield with_columns(part, ("__text",), **new)

    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("__text"))
    new = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    return source.mapInArrow(run, T.StructType([*kept, *new]))


def emit(ids: list[int], labels: dict[int, str]) -> str:
    """Labels of the arcs, joined by one space (the tokenizer file names no decoder)."""
    return " ".join([labels[i] for i in ids if i in labels])


def decode(coded: DataFrame, tokenizer, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the labels of the ids' arcs joined by one space; ids without a label are skipped, null
    and empty lists give an empty text."""
    kept = [f for f in coded.schema.fields if f.name != text]

    def run(batches: Batches) -> Batches:
        labels = cloudpickle.loads(tokenizer.value).labels
        for batch in batches:
            yield with_columns(batch, **{text: pa.array([emit(v or [], labels) for v in column_values(batch, ids)], pa.string())})

    return coded.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, tokenizer) -> DataFrame:
    """``doc_id``, number of tokens, sha256 of the ids in decimal and of the decoded text. Texts are encoded
    and decoded in one pass, by one Python worker."""
    both = _coded(docs.select("doc_id", "text"), tokenizer, "text", "ids", "decoded")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
