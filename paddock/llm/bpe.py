"""Byte-level BPE encoding and decoding over Arrow batches.

The tiktoken library cuts whole texts into pieces by the pattern and merges their bytes by rank.  Decoding looks up each
id's bytes; what characters these bytes begin and go on tells each token's offsets in the text.

Texts that tiktoken gives up on (a pattern that looks back over hundreds of thousands of white spaces overflows its
stack) are encoded by the tokenizers library, with the same ids.  There, the byte-level alphabet maps each byte to one
printable character, so that a vocabulary of byte strings becomes one of plain strings.  Rank files (base64 token, rank)
carry no merges: they follow from the ranks, as every split of a token into two known tokens.

What a task holds follows from its slice of texts, and where one text is longer than that, from this text: about 30
bytes for each of its bytes, 60 where the tokenizers library encodes it.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import text_slices

ENCODED = "doc_id long, ids array<int>, begins array<int>, ends array<int>"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long, n_split long"
SLICE_BYTES = 500_000  #: about how much text is encoded at a time


@lru_cache(1)
def byte_chars() -> list[str]:
    """The character of each byte: printable Latin-1 characters stand for themselves, the others are moved to U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return [moved.get(b, chr(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens whose concatenation is a token, in the order in which the ranks apply them."""
    found = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                found.append((rank, ranks[left], ranks[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


@lru_cache(2)
def encoding(path: str, pattern: str):
    """A tiktoken.Encoding by the rank file at ``path``; ``pattern`` cuts texts into pieces."""
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(2)
def tokenizer(path: str, pattern: str):
    """A tokenizers.Tokenizer that gives the ids of the rank file at ``path``; ``pattern`` cuts texts into pieces."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_chars()
    name = lambda token: "".join(chars[b] for b in token)
    model = models.BPE({name(t): r for t, r in ranks.items()}, [(name(a), name(b)) for a, b in merges_of(ranks)], ignore_merges=True)
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made


@lru_cache(2)
def byte_table(path: str) -> pa.Array:
    """The reverse table: the bytes of each id, null where there is no such id."""
    table = {rank: token for token, rank in read_ranks(path).items()}
    return pa.array([table.get(i) for i in range(max(table) + 1)], pa.large_binary())


def token_bytes(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ends, data): the bytes of all ids in a row, and where each id's begin (with the end).

    Ids that the vocabulary doesn't have raise a ValueError.
    """
    table = byte_table(path)
    if not len(ids):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    known = (ids >= 0) & (ids < len(table))
    taken = table.take(pa.array(np.where(known, ids, 0)))
    unknown = ids[~known] if not known.all() else ids[taken.is_null().to_numpy(zero_copy_only=False)] if taken.null_count else ids[:0]
    if len(unknown):
        raise ValueError(f"no token has the id {unknown[0]}")
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]
    return ends, np.frombuffer(taken.buffers()[2], np.uint8)[: ends[-1]]


def _cut(data: np.ndarray, at: np.ndarray) -> list[memoryview]:
    return [memoryview(data)[a:b] for a, b in itertools.pairwise(at.tolist())]


def decoded(ids: np.ndarray, bounds: np.ndarray, path: str) -> list[memoryview]:
    """The exact bytes of each sequence: ``bounds`` tells where sequences begin in ``ids``, and where the last one ends.

    One character's bytes may be split over tokens, so only a whole sequence is sure to be UTF-8.  Ids that the
    vocabulary doesn't have raise a ValueError.
    """
    ends, data = token_bytes(ids, path)
    return _cut(data, ends[bounds])


def decode_bytes(ids: list[int], path: str) -> bytes:
    return bytes(decoded(np.array(ids, np.int64), np.array([0, len(ids)]), path)[0])


def encoded(texts: list[str | None], made) -> tuple[list, np.ndarray, np.ndarray]:
    """(encodings, ids, bounds) of texts by the library: all ids in a row, and where each text's ids begin (with the end)."""
    found = made.encode_batch([t or "" for t in texts], add_special_tokens=False)
    bounds = np.cumsum([0, *map(len, found)])
    return found, np.fromiter(itertools.chain.from_iterable(e.ids for e in found), np.int64, int(bounds[-1])), bounds


def spans_of(found: list) -> np.ndarray:
    """The characters (begin, end) of its text that each token of the encodings covers."""
    flat = itertools.chain.from_iterable(itertools.chain.from_iterable(e.offsets for e in found))
    return np.fromiter(flat, np.int32, 2 * sum(map(len, found))).reshape(-1, 2)


def coded(texts: list[str | None], path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of texts: all ids in a row, and where each text's ids begin (with the end)."""
    own, found = encoding(path, pattern), []
    for text in texts:
        try:
            found.append(own.encode_ordinary(text or ""))
        except BaseException as error:
            if type(error).__name__ != "PanicException":  # the library has no other name for it
                raise
            found.append(encoded([text], tokenizer(path, pattern))[1].tolist())
    bounds = np.cumsum([0, *map(len, found)])
    return np.fromiter(itertools.chain.from_iterable(found), np.int64, int(bounds[-1])), bounds


def char_spans(ends: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The characters (begin, end) of its text that each token covers, by the tokens' bytes; every text is UTF-8."""
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters that begin before each byte, and the end
    earlier = np.repeat(begun[ends[bounds[:-1]]], np.diff(bounds))
    return np.stack([begun[ends[:-1] + 1] - 1 - earlier, begun[ends[1:]] - earlier], axis=1).astype(np.int32)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and offsets of every whole text: (doc_id, ids, begins, ends).

    Offsets count characters; tokens that share a character all carry that character's span.  A null or empty
    text has no ids; a null doc_id is kept; repeated rows come back repeated; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1, SLICE_BYTES):
            ids, bounds = coded(part.column(1).to_pylist(), path, pattern)
            spans = char_spans(*token_bytes(ids, path), bounds)
            of = lambda x: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32()))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([part.column(0), of(ids), of(spans[:, 0]), of(spans[:, 1])], ["doc_id", "ids", "begins", "ends"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ENCODED)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of id sequences; bytes that are not UTF-8 (a sequence cut within a character) become
    U+FFFD, null ids a null text; ids that aren't in the vocabulary, null ones included, fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
            texts = [str(x, "utf-8", "replace") if ok else None for x, ok in zip(decoded(ids, bounds, path), lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")


def split_characters(bounds: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """How many characters of each text are split over tokens: runs of tokens whose spans overlap."""
    shared = np.zeros(len(spans), bool)
    shared[1:] = spans[1:, 0] < spans[:-1, 1]
    shared[bounds[:-1][bounds[:-1] < len(spans)]] = False
    first = shared.copy()
    first[1:] &= ~(shared[:-1] & (spans[1:, 0] == spans[:-1, 0]))
    return np.diff(np.concatenate([[0], np.cumsum(first)])[bounds])


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes its ids: (doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars, n_split).

    The digests are of the decimal ids joined by commas and of the decoded bytes; ``n_chars`` counts the code points up to
    the last token's offset and ``n_split`` those whose bytes are split over tokens.  Encoding and decoding
    share one pass, so ids never leave the task.  Nulls as in :func:`encode`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1, SLICE_BYTES):
            ids, bounds = coded(part.column(1).to_pylist(), path, pattern)
            ends, data = token_bytes(ids, path)
            spans, chars, some = char_spans(ends, data, bounds), np.zeros(part.num_rows, np.int64), np.diff(bounds) > 0
            chars[some] = spans[bounds[1:][some] - 1, 1]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pc.cast(pa.array(ids), pa.string())), ",")
            columns = [
                part.column(0),
                pa.array(np.diff(bounds)),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined.to_pylist()], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in _cut(data, ends[bounds])], pa.string()),
                pa.array(chars),
                pa.array(split_characters(bounds, spans)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars", "n_split"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, DIGEST)
