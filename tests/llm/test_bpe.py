"""The tokenizer against tiktoken, and round trips of awkward texts."""

import base64
import hashlib
import itertools

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from paddock.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "\n\n  a", "it's we'll 'tis ''s", "naïve café 12345 ½ ٣", "日本語のテキスト", "👩‍👩‍👧 flags 🇰🇷", "x" * 5000, "a b　c\x85d", "tab\t\ttab  end  ", "'ſ 'S don'T", "é ‍", "\x00\x01"]


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


OWN = tik()


def test_round_trip_equals_tiktoken(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "b", "x")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, P.PATTERN).collect())
    own, want = tik(), []
    for i, t, _ in rows:
        ids = own.encode_ordinary(t or "")
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    counted = {r.doc_id: (r.n_chars, r.n_split) for r in bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, P.PATTERN).collect() if r.doc_id is not None}
    for i, t in enumerate(TEXTS):
        spans = [(a, b) for _, (a, b) in zip(own.encode_ordinary(t or ""), bpe.tokenizer(PATH, P.PATTERN).encode(t or "", add_special_tokens=False).offsets, strict=True)]
        assert counted[i] == (len(t or ""), sum(sum(a <= k < b for a, b in spans) > 1 for k in range(len(t or "") if t != "x" * 5000 else 0)))


def test_encode_offsets_and_decode(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    coded = bpe.encode(docs, PATH, P.PATTERN)
    own = tik()
    for r in coded.collect():
        assert list(r.ids) == own.encode_ordinary(TEXTS[r.doc_id] or "")
        assert len(r.begins) == len(r.ids) == len(r.ends)
        assert not r.ids or r.ends[-1] == len(TEXTS[r.doc_id])
    assert {r.doc_id: r.text for r in bpe.decode(coded, PATH).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_split_characters():
    """Tokens inside a character: each one's bytes are no text, together they are, and the round trip counts them."""
    made, own = bpe.tokenizer(PATH, P.PATTERN), tik()
    text = "日a👩‍👩‍👧 ½é 𓀀𓀀"
    found, ids, bounds = bpe.encoded([text, "", None, "ab", text], made)
    spans = bpe.spans_of(found)
    assert ids[: bounds[1]].tolist() == own.encode_ordinary(text)
    each = [bytes(x) for x in bpe.decoded(ids[: bounds[1]], np.arange(bounds[1] + 1), PATH)]
    assert b"".join(each) == text.encode()
    inside = {k for k in range(len(text)) if sum(a <= k < b for a, b in spans[: bounds[1]].tolist()) > 1}
    assert inside and bpe.split_characters(bounds, spans).tolist() == [len(inside), 0, 0, 0, len(inside)]
    whole = [k for k, (a, b) in enumerate(spans[: bounds[1]].tolist()) if not inside & set(range(a, b))]
    assert all(each[k].decode() == text[spans[k][0] : spans[k][1]] for k in whole)


@pytest.mark.parametrize("wrong", [-1, 10**6, 2**31 - 1])
def test_unknown_ids_raise(wrong):
    with pytest.raises(ValueError, match=str(wrong)):
        bpe.decode_bytes([1, wrong], PATH)


def test_gaps_in_a_vocabulary_raise(tmp_path):
    path = str(tmp_path / "gap.tiktoken")
    with open(path, "wb") as f:
        f.writelines(base64.b64encode(bytes([b])) + b" %d\n" % (b + (b > 9)) for b in range(256))
    assert bpe.decode_bytes([9, 11], path) == b"\x09\x0a"
    with pytest.raises(ValueError, match="10"):
        bpe.decode_bytes([9, 10], path)


def test_decode_of_cut_sequences_and_nulls(spark):
    ids = tik().encode_ordinary("日本")
    rows = [(1, ids), (2, ids[:1]), (3, None), (4, []), (None, ids)]
    got = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    assert got == {1: "日本", 2: bpe.decode_bytes(ids[:1], PATH).decode("utf-8", "replace"), 3: None, 4: "", None: "日本"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_ids_equal_tiktoken(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    _, ids, bounds = bpe.encoded(texts, bpe.tokenizer(PATH, P.PATTERN))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == OWN.encode_ordinary_batch(texts)


def test_other_patterns_cut_as_tiktoken_does():
    pattern = r"\p{L}{1,3}|\p{N}|[^\p{L}\p{N}]+"
    own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    assert bpe.encoded(["naïve 1234 text, here", "x"], bpe.tokenizer(PATH, pattern))[1].tolist() == own.encode_ordinary("naïve 1234 text, here") + own.encode_ordinary("x")


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_ids_and_offsets_equal_the_tokenizers_library(texts):
    """Offsets that follow from the tokens' bytes are those that the other library counts."""
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["日a👩‍👩‍👧 ½é 𓀀𓀀", None, ""]
    found, want, of = bpe.encoded(texts, bpe.tokenizer(PATH, P.PATTERN))
    ids, bounds = bpe.coded(texts, PATH, P.PATTERN)
    assert ids.tolist() == want.tolist() and bounds.tolist() == of.tolist()
    assert bpe.char_spans(*bpe.token_bytes(ids, PATH), bounds).tolist() == bpe.spans_of(found).tolist()


def test_ordinary_texts_do_without_the_slower_library(monkeypatch):
    """It takes some six times the CPU time; only texts that tiktoken gives up on are left to it."""
    monkeypatch.setattr(bpe, "tokenizer", None)
    assert bpe.coded(["naïve 日本", "x" * 100_000], PATH, P.PATTERN)[0].tolist() == OWN.encode_ordinary("naïve 日本") + OWN.encode_ordinary("x" * 100_000)


def test_texts_that_tiktoken_gives_up_on(spark):
    texts = ["a" + " " * 1_000_000 + "é", "b c", "\n" * 1_000_000]
    ids, bounds = bpe.coded(texts, PATH, P.PATTERN)
    assert [bytes(x) for x in bpe.decoded(ids, bounds, PATH)] == [t.encode() for t in texts]
    assert ids[bounds[1] : bounds[2]].tolist() == OWN.encode_ordinary("b c")
    assert ids.tolist() == bpe.encoded(texts, bpe.tokenizer(PATH, P.PATTERN))[1].tolist()
    got = {r.doc_id: (r.n_tokens, r.n_chars, r.decoded_sha256) for r in bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, P.PATTERN).collect()}
    assert got == {i: (bounds[i + 1] - bounds[i], len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)}
