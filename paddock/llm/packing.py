"""Packing of tokenised documents into training sequences of several lengths.

Hierarchical: a document longer than the longest context fills whole windows of it; what is left of it, like any shorter
document, is routed to the smallest context that holds it.  Each tier is packed, the longest first: a window opens
with a document of its tier, its gap takes whole documents of shorter tiers, the longest that fits first, and the
last of the gap the head of the shortest one left, whose tail stays for another window.  So windows are full,
whatever their context.  Windows are dealt to steps, the largest to the step with the fewest tokens, so that steps of a
group hold the same number of tokens in windows of all contexts.

Every partition of the input is packed on its own, in groups of about a million tokens, so texts and ids
aren't shuffled and no key gathers.  A group hands its one unfinished window on to the next; what the last one leaves is cut
into windows of powers of two.  A partition that runs again gives the same rows as long as its rows come in the same
order, as those of a file do.

Texts are tokenised by distinct units, each by the library once: the tokenizer drops white space, so the words
between it are tokenised alike wherever they stand, and a word of Latin letters, digits and signs is further the pieces that its
pattern makes.  A task holds a slice of texts and a group of ids (or one text, where it is longer).
"""

from __future__ import annotations

import bisect
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import text_slices

CONTEXTS = (512, 1024, 2048, 4096)  #: powers of two, the longest last
GROUP_TOKENS, STEP_TOKENS = 1 << 20, 1 << 17
KNOWN_WORDS = 400_000  #: units whose ids a task remembers
SLICE_BYTES = 2_000_000
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, context int, step long, ids binary"

Piece = tuple[int, int, int]  #: document, where it begins there, tokens


#: What each ASCII byte is to the tokenizer: white space, a letter, a digit, a sign, or cause to leave a word to it whole.
_SPACE, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)
_KIND = np.full(256, _WHOLE, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[0x20, *range(9, 14)]] = _SPACE
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[ord("'")] = _WHOLE


@lru_cache(2)
def tokenizers_of(path: str):
    """(the tokenizer, the same model for pieces between spaces, whether each id ends a piece)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    made, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
    bare.normalizer, bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = made.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return made, bare, ends


def units_of(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(units, whether each is one piece, where each begins): pieces of the tokenizer where words are ASCII or Latin-1
    letters (in lower case), single digits and runs of signs, and otherwise whole words, which the library takes apart."""
    b = np.frombuffer(data, np.uint8)
    kind, lower = _KIND[b], (b >= ord("A")) & (b <= ord("Z"))
    accented = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] & 0xC0 == 0x80) & (b[1:] & 0xDF != 0x97)) if len(b) else np.zeros(0, np.int64)  # U+00C0 to U+00FF but for the signs of times and division
    kind[accented] = kind[accented + 1] = _LETTER
    lower[accented + 1] = b[accented + 1] < 0x9F
    inside = kind != _SPACE
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    word = np.cumsum(first)  # of each byte, from 1
    odd = kind == _WHOLE
    odd[:-1] |= (b[:-1] == ord("<")) & (b[1:] == ord("|"))  # special tokens are spelled so
    whole = np.zeros(int(word[-1]) + 1 if len(b) else 1, bool)
    whole[word[odd]] = True
    plain = ~whole[word]
    begins = first.copy()
    begins[1:] |= plain[1:] & inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    at = np.flatnonzero(begins)
    letters = np.where(lower & plain, b + 32, b)[inside]
    place = np.cumsum(inside) - 1  # of each byte that stays
    offsets = np.append(place[at], len(letters)).astype(np.int32)
    units = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return units, plain[at], at


class Words:
    """Ids of many texts at once: each distinct unit is tokenised by the library once and remembered."""

    def __init__(self, path: str):
        self.made, self.bare, self.ends = tokenizers_of(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.first, self.n = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def learn(self, units: list[str], plain: list[bool]) -> None:
        """Adds units that aren't known."""
        whole = [u for u, p in zip(units, plain) if not p]
        pieces = [u for u, p in zip(units, plain) if p]
        joined = [" ".join(pieces[k : k + 100]) for k in range(0, len(pieces), 100)]
        ids = [np.array(e.ids, np.int32) for e in self.bare.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        lengths = np.diff(np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1]))
        if len(lengths) != len(pieces):
            raise ValueError("each piece must end with one token that says so")
        others = [e.ids for e in self.made.encode_batch_fast(whole, add_special_tokens=False)]
        n = np.concatenate([lengths, [len(x) for x in others]]).astype(np.int32)
        self.known.update(zip(pieces + whole, range(len(self.n), len(self.n) + len(n))))
        self.first = np.concatenate([self.first, (len(self.flat) + np.cumsum(n) - n).astype(np.int32)])
        self.n = np.concatenate([self.n, n])
        self.flat = np.concatenate([self.flat, ids, *[np.array(x, np.int32) for x in others]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids begin, with the end); a null text is an empty one."""
        data = [x.as_py().encode("utf-8") if x.is_valid else b"" for x in texts]
        starts = np.cumsum([0, *(len(x) + 1 for x in data)])
        coded, plain, at = units_of(b"\n".join(data) + b"\n")
        coded = coded.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        units = coded.dictionary.to_pylist()
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        found = np.fromiter((self.known.get(u, -1) for u in units), np.int64, len(units))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            is_plain = np.zeros(len(units), bool)
            is_plain[which[plain]] = True
            self.learn([units[i] for i in new], is_plain[new].tolist())
            found[new] = [self.known[units[i]] for i in new]
        n, first = self.n[found][which], self.first[found][which]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat((first - ends[:-1]).astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32)]
        return ids, ends[np.searchsorted(at, starts)]


def pack(pieces: list[Piece], contexts: tuple[int, ...] = CONTEXTS, last: bool = False) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(full windows, rest) of some pieces: each window with its context; the rest is less than a window of the longest
    context, and if ``last``, there is none: it is cut into windows of powers of two."""
    windows, pool, rest = [], [], []
    for of, start, n in pieces:
        while n >= contexts[-1]:
            windows.append((contexts[-1], [(of, start, contexts[-1])]))
            start, n = start + contexts[-1], n - contexts[-1]
        if n:
            pool.append((n, of, start))
    pool.sort()
    for context in reversed(contexts):
        least = context // 2 if context > contexts[0] else 0
        while pool and pool[-1][0] > least:
            n, of, start = pool.pop()
            window, room = [(of, start, n)], context - n
            while room and pool:
                at = bisect.bisect_left(pool, (room + 1,)) - 1
                if at >= 0:
                    n, of, start = pool.pop(at)
                    window.append((of, start, n))
                    room -= n
                else:
                    n, of, start = pool.pop(0)
                    window.append((of, start, room))
                    bisect.insort(pool, (n - room, of, start + room))
                    room = 0
            if room:
                rest = window
            else:
                windows.append((context, window))
    if last and rest:
        left, rest = rest, []
        total = sum(n for *_, n in left)
        while total:
            size = room = 1 << (total.bit_length() - 1)
            window = []
            while room:
                of, start, n = left.pop(0)
                if n > room:
                    left.insert(0, (of, start + room, n - room))
                    n = room
                window.append((of, start, n))
                room -= n
            windows.append((size, window))
            total -= size
    return windows, rest


def balanced(windows: list[tuple[int, list[Piece]]], step_tokens: int = STEP_TOKENS) -> list[list[tuple[int, list[Piece]]]]:
    """Steps of windows: the largest window first, each to the step with the fewest tokens."""
    total = sum(c for c, _ in windows)
    steps = [[] for _ in range(max(1, round(total / step_tokens)))] if windows else []
    load = [(0, k) for k in range(len(steps))]
    for context, window in sorted(windows, key=lambda w: -w[0]):
        tokens, k = heapq.heappop(load)
        steps[k].append((context, window))
        heapq.heappush(load, (tokens + context, k))
    return steps


class _Packer:
    """Packs the documents of one partition, a group at a time."""

    def __init__(self, partition: int, contexts: tuple[int, ...], step_tokens: int):
        self.contexts, self.step_tokens = contexts, step_tokens
        self.sequence = self.step = partition << 33
        self.rest: list[Piece] = []
        self.docs: dict[int, tuple[int | None, np.ndarray]] = {}
        self.new: list[Piece] = []
        self.tokens = self.number = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs[self.number] = (doc_id, ids)
        self.new.append((self.number, 0, len(ids)))
        self.number, self.tokens = self.number + 1, self.tokens + len(ids)

    def packed(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        windows, self.rest = pack(self.rest + self.new, self.contexts, last)
        rows, parts = [], []
        for step in balanced(windows, self.step_tokens):
            for context, window in step:
                offset = 0
                for of, start, n in window:
                    doc_id, ids = self.docs[of]
                    rows.append((doc_id, start, n, len(ids), self.sequence, offset, context, self.step))
                    parts.append(ids[start : start + n].astype("<u4", copy=False).tobytes())
                    offset += n
                self.sequence += 1
            self.step += 1
        self.docs = {of: self.docs[of] for of, *_ in self.rest}
        self.new, self.tokens = [], 0
        kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64()]
        names = [x.split()[0] for x in PIECES.split(", ")]
        for k in range(0, len(rows), 4096):  # a long document's ids leave in many batches
            columns = [pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096]), kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(parts[k : k + 4096], pa.binary())], names)


def packed(docs: DataFrame, path: str, end_id: int, contexts: tuple[int, ...] = CONTEXTS, group_tokens: int = GROUP_TOKENS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document: (doc_id, start, length, doc_tokens, sequence_id, offset, context, step, ids).

    A document is the ids of its whole text by the tokenizer at ``path``, without special tokens, and then ``end_id``;
    ``doc_tokens`` counts all of them and ``ids`` holds the piece's as little-endian unsigned 32-bit numbers.  A
    sequence has exactly ``context`` tokens: one of ``contexts``, or at the end of a partition a smaller power of two.
    The tokenizer must be like word_bpe_49k: lower case, no white space, pieces of letters, digits and signs.  A null text is an empty one, of one token; a null doc_id is kept;
    repeated rows are documents of their own; other columns are not read.
    """
    if any(c & (c - 1) or c < 1 for c in contexts) or list(contexts) != sorted(set(contexts)):
        raise ValueError("contexts must be rising powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, packer = Words(path), _Packer(TaskContext.get().partitionId(), contexts, step_tokens)
        for part in text_slices(batches, 1, SLICE_BYTES):
            ids, bounds = words.encode(part.column(1))
            for k, doc_id in enumerate(part.column(0).to_pylist()):
                packer.add(doc_id, np.append(ids[bounds[k] : bounds[k + 1]], np.int32(end_id)))
                if packer.tokens >= group_tokens:
                    yield from packer.packed()
        yield from packer.packed(last=True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
