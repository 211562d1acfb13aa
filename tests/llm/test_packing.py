"""Packed sequences against texts tokenised one by one: every id once, windows full, steps even."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paddock.llm import packing
from paddock.llm import queries as Q

PATH = P.path("word_bpe_49k.json")
MADE = packing.tokenizers_of(PATH)[0]
ALPHABET = [*"abcABC'sdtİIıſßΣσς.,!0١½éÀÉ×÷ÿ   ̱́　\x85\x1c\x1f\x00\t\n\r\x0b\x0c<|>~", "<|endoftext|>", "<|startoftext|>", "<|STARTOFTEXT|>", "가", "ᄀ", "ᅡ", "👩‍👩", "don't", "H̱"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=20) | st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join), max_size=5))
def test_ids_equal_the_library(texts):
    ids, bounds = packing.Words(PATH).encode(pa.array([*texts, None], pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [MADE.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 10_000), max_size=60), st.booleans())
def test_packs_every_token_once(lengths, last):
    windows, rest = packing.pack([(i, 0, n) for i, n in enumerate(lengths)], last=last)
    spans = defaultdict(list)
    for context, window in windows:
        assert sum(n for *_, n in window) == context and context & (context - 1) == 0 and context <= 4096
        assert last or context in packing.CONTEXTS
        for of, start, n in window:
            spans[of].append((start, n))
    assert sum(n for *_, n in rest) < 4096 and not (last and rest)
    for of, start, n in rest:
        spans[of].append((start, n))
    for of, total in enumerate(lengths):
        at = 0
        for start, n in sorted(spans[of]):
            assert start == at and n > 0
            at += n
        assert at == total
    loads = [sum(c for c, _ in step) for step in packing.balanced(windows, 1 << 14)]
    assert sum(loads) == sum(c for c, _ in windows) and (not loads or max(loads) - min(loads) <= 4096)


def held(rows, texts):
    """Checks pieces against texts (a list of (doc_id, text)) and returns the sequences' lengths."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.crc, r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    times = Counter(i for i, _ in texts)
    for doc_id, text in dict(texts).items():
        ids = np.array([*MADE.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        whole = Counter()
        for start, n, crc, total in docs.pop(doc_id):
            assert total == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())
            whole.update(range(start, start + n))
        assert whole == Counter({k: times[doc_id] for k in range(len(ids))})
    assert not docs
    return Counter(sum(n for _, n in s) for s in sequences.values())


def test_pieces_of_awkward_documents(spark):
    from pyspark.sql import functions as F

    texts = [(1, None), (2, ""), (3, " \n"), (None, "no id"), (4, "one word twice"), (4, "one word twice"), (5, "a long document, " * 9_000), *((i, "some words of text " * (i % 300)) for i in range(10, 900))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, ids string, step int").repartition(3)
    made = packing.packed(docs, PATH, end_id=2, group_tokens=50_000, step_tokens=16_384)
    rows = made.select("*", F.crc32("ids").alias("crc")).collect()
    sizes = held(rows, texts)
    assert set(packing.CONTEXTS) <= set(sizes) and sum(n for s, n in sizes.items() if s < 512) <= 3 * 9
    assert packing.packed(docs.limit(0), PATH, 2).collect() == []
    with pytest.raises(ValueError, match="powers of two"):
        packing.packed(docs, PATH, 2, contexts=(512, 1000))


def test_query_packs_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = Q.op12_multi_length_packing(spark, sf).withColumnRenamed("ids_crc32", "crc").collect()
    held(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
