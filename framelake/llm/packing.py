"""Cost-balanced packing of tokenised documents into sequences of bounded length.

The cost of a piece of n tokens is ``linear * n + quadratic * n**2``: its share of dense layers and of attention
within the document.  Documents are tokenised where they are read and packed in groups of about ``GROUP_TOKENS``
tokens of one task, so nothing is shuffled and memory is bounded however large the table is.  A group of T tokens gets
T // 4096 full sequences and, for the rest, sequences whose capacities are the powers of two that sum to it, so no
sequence needs padding.  Whole-sequence pieces of long documents go first; then documents in descending length go to
the lowest-cost sequence with room for all of it, or, when none has, are cut over the lowest-cost sequences with room.

Nulls and edge cases: a null text is an empty one and has the end id alone; a null ``doc_id`` is kept; repeated rows
are packed as often as they come; an empty table gives no rows.  Other columns are not read.  A sequence id is the
task's partition number and a counter, so a retried task gives the same ids.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_column

LENGTH, END_ID = 4096, 2
GROUP_TOKENS = 1 << 20
#: Words whose ids a task remembers; beyond that those that came once go.
CACHE_WORDS = 1_000_000
LINEAR, QUADRATIC = 1.0, 1 / 2048
#: Words of lower-case Latin-1 letters alone.
SIMPLE = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Characters that are a letter or digit by themselves, whatever stands before them, and stay one when normalised.
ENDS_TOKEN = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | frozenset(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
PIECES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class WordTokens:
    """Token ids of words, remembered.

    The vocabulary drops white space and never joins across it, so the ids of a text are those of its words in turn.
    A text within Latin-1 is lower-cased first (the normaliser does the same there); any other goes word by word as
    it is, and the tokenizer normalises it.
    """

    MARK = "~"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = self._letters_only(path)
        self.mark = self.encode(self.MARK)[0]
        self.stops = {c: self.encode(c)[0] for c in ".,"}
        self.clear()

    @staticmethod
    def _letters_only(path: str):
        """The same merges for words of lower-case Latin-1 letters alone, which the normaliser and the splitting
        pattern leave as they are; without them, and without the model's own cache, new words take half the time."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        found = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=1, end_of_word_suffix=model["end_of_word_suffix"]))
        found.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return found

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        """Starts anew, but for the half of the words that came more than once most often."""
        if hasattr(self, "known"):
            some = np.flatnonzero(self.uses > 1)
            some = np.sort(some[np.argsort(-self.uses[some], kind="stable")[: CACHE_WORDS // 2]])
            names = list(self.known)
            kept = [names[i] for i in some.tolist() if i]
            index = np.array([i for i in some.tolist() if i], np.int64)
            sizes = self.sizes[index]
            ends = np.cumsum(sizes)
            pool = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[index] - (ends - sizes), sizes)]
        else:
            kept, pool, sizes = [], np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._empty()
        self._add(kept, [pool], sizes)

    def _empty(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.uses = np.zeros(1, np.int64)
        self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def words(self, text: str) -> list[str]:
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def learn(self, words: list[str]) -> None:
        """Adds new, distinct words.  A letter or digit ends a token before a stop or comma, so such a word is its
        stem's ids and the mark's (some letters end in a combining mark once they are lower-cased, which would join the
        stop: those do not count); all other words go to the tokenizer in one text, set apart by a mark."""
        stems = {w: w[:-1] for w in words if w[-1:] in self.stops and w[-2:-1] in ENDS_TOKEN}
        bare = list(dict.fromkeys([w for w in words if w not in stems] + [s for s in stems.values() if s not in self.known]))
        marks = [w for w in bare if self.MARK in w]
        simple = list(filter(SIMPLE, bare))
        others = set(bare).difference(simple, marks) if len(simple) < len(bare) else ()
        for tokenizer, some in ((self.letters, simple), (self.tokenizer, list(others))):
            if some:
                ids = np.array(tokenizer.encode(f" {self.MARK} ".join(some), add_special_tokens=False).ids, np.uint32)
                cuts = np.flatnonzero(ids == self.mark)
                self._add(some, [ids[ids != self.mark]], np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1)
        for word in marks:
            ids = np.array(self.encode(word), np.uint32)
            self._add([word], [ids], np.array([len(ids)], np.int64))
        if stems:
            index = np.array([self.known[s] for s in stems.values()], np.int64)
            sizes = self.sizes[index] + 1
            ends = np.cumsum(sizes)
            place = np.arange(ends[-1]) + np.repeat(self.starts[index] - (ends - sizes), sizes)
            ids = self.pool[np.minimum(place, len(self.pool) - 1)]
            ids[ends - 1] = [self.stops[w[-1]] for w in stems]
            self._add(list(stems), [ids], sizes)

    def _add(self, words: list[str], ids: list[np.ndarray], sizes: np.ndarray) -> None:
        ends = len(self.pool) + np.cumsum(sizes)
        first = len(self.starts)
        self.starts = np.concatenate((self.starts, ends - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.pool = np.concatenate((self.pool, *ids))
        self.uses = np.concatenate((self.uses, np.zeros(len(words), np.int64)))
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.words(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.clear()
        get = self.known.get
        indexes = [[get(w, -1) for w in words] for words in split]
        new = list({w for words, index in zip(split, indexes, strict=True) if -1 in index for w, i in zip(words, index, strict=True) if i < 0})
        for at in range(0, len(new), 4096):
            self.learn([w for w in new[at : at + 4096] if w not in self.known])
        out = []
        for words, numbers in zip(split, indexes, strict=True):
            index = np.array(numbers, np.int64)
            late = np.flatnonzero(index < 0)
            index[late] = [get(words[i]) for i in late.tolist()]
            self.uses[index] += 1
            sizes = self.sizes[index]
            ends = np.cumsum(sizes)
            where = np.arange(ends[-1]) + np.repeat(self.starts[index] - (ends - sizes), sizes)
            out.append(self.pool[where])
        return out


TOKENIZERS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One tokenizer for each worker process and vocabulary."""
    if path not in TOKENIZERS:
        TOKENIZERS[path] = WordTokens(path)
    return TOKENIZERS[path]


def capacities(tokens: int, length: int = LENGTH) -> np.ndarray:
    """Sequence lengths that hold exactly so many tokens: full ones, then descending powers of two."""
    rest = tokens % length
    return np.array([length] * (tokens // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def pack(lengths: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, size, sequence, offset) that cover every document and fill every sequence."""
    size = capacities(sum(lengths), length)
    room, cost = size.copy(), np.zeros(len(size))
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, n: int, at: int) -> None:
        pieces.append((doc, start, n, at, int(size[at] - room[at])))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n

    full, rests = 0, []
    for doc, n in enumerate(lengths):
        whole = n // length
        for k in range(whole):
            put(doc, k * length, length, full)
            full += 1
        if n % length:
            rests.append((n % length, doc, whole * length))
    for n, doc, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while n:
            fits = np.flatnonzero(room >= n)
            if len(fits):
                at, take = int(fits[np.argmin(cost[fits])]), n
            else:
                open_ = np.flatnonzero(room)
                at = int(open_[np.argmin(cost[open_])])
                take = int(room[at])
            put(doc, start, take, at)
            start, n = start + take, n - take
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; ``with_ids`` adds each piece's token ids."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(name, T.LongType()) for name in PIECES)])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_column(text_col).alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer)
        next_id = TaskContext.get().partitionId() << 33
        ids: list[np.ndarray] = []
        names: list[pa.Array] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal next_id
            lengths = [len(x) for x in ids]
            cut = np.array(pack(lengths, length), np.int64).reshape(-1, 5)
            parts = [ids[d][a : a + n] for d, a, n in cut[:, :3].tolist()]
            crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
            columns = [pa.concat_arrays(names).take(pa.array(cut[:, 0])), cut[:, 1], cut[:, 2], crc, np.array(lengths, np.int64)[cut[:, 0]], cut[:, 3] + next_id, cut[:, 4]]
            next_id += len(capacities(sum(lengths), length))
            arrays = [columns[0], *(pa.array(c, pa.int64()) for c in columns[1:])]
            if with_ids:
                arrays.append(pa.array([p.tolist() for p in parts], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        end = np.array([end_id], np.uint32)
        for part in slices(batches, "text", 1 << 20):
            new = [np.concatenate((x, end)) for x in words.ids_of(part.column("text").to_pylist())]
            ids += new
            names.append(part.column("doc_id"))
            held += sum(map(len, new))
            if held >= group_tokens:
                yield packed()
                ids, names, held = [], [], 0
        if ids:
            yield packed()

    return rows.mapInArrow(of, schema)


def query(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Contract query of operator 1."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer)
