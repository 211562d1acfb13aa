"""Substring duplicates by prefix-partitioned suffix trees.

A window of W words that occurs elsewhere has, at the same place there, the same anchor: the run of K words
whose hash is the least in the window.  Suffixes therefore belong to anchors only (about 1 word in 20), and of
those only to anchors that occur in two documents.  A partition is the suffixes with one prefix: at first those
that begin at an anchor, by its K words.  It becomes a suffix tree over the W words from the anchor, kept as sorted
suffixes with the lengths of their common prefixes, and a second one over the words before it, read backwards.  A
node of the first tree at depth W - s together with one of the second at depth s is a repeat of W words that
begins s words before the anchor; deeper nodes only repeat more of the same text.

Where a partition holds more suffixes than a task should, its prefix is lengthened.  All windows that begin lo to hi
words before the anchor share the W - (hi - lo) words from lo words before it on: that is the prefix of a suffix
which begins there.  So the partition is cut in four by where windows begin, each piece being partitioned by a longer
prefix (8, 40, 48, 50 words for W = 50), until all fit.  At each length, suffixes with the same words are one, that of
the smallest document, and the others are covered as far as their windows reach; so a passage that is copied very
often is settled, and only what differs around its ends goes on.

Documents with the same words are one document (that with the smallest id) before any of this; the others are
covered as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import join_small, text_slices, written
from paddock.llm.hashing import grams, word_hashes

WINDOW, PREFIX = 50, 8
GROUP_ROWS = 2_500  #: most suffixes of one prefix that meet in a task: some 15 MB with their trees
CHUNK_ROWS = 8_192  #: suffixes that a task sorts at a time, in whole groups
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _sliding(x: np.ndarray, width: int, ufunc) -> np.ndarray:
    """Least (or greatest) of each run of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = ufunc(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(hashes: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of every window of a document's words, and their hashes; all of them at ties.  And how many
    words before an anchor its windows begin, at least and at most: they are consecutive, and each is its anchor's alone
    but for ties."""
    if len(hashes) < window:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    g, width = grams(hashes, prefix), window - prefix + 1
    least = _sliding(g, width, np.minimum)  # one per window
    # a place is an anchor if it is the least of some window over it: of those windows' least ones, the greatest
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    places = np.flatnonzero(_sliding(padded, width, np.maximum) == g)
    lo, hi = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    for k in range(0, len(places), 4_096):  # in blocks, as each anchor looks at all windows over it
        own = places[k : k + 4_096]
        mine = np.lib.stride_tricks.sliding_window_view(padded, width)[own] == g[own, None]
        lo[k : k + 4_096], hi[k : k + 4_096] = mine[:, ::-1].argmax(axis=1), width - 1 - mine.argmax(axis=1)
    return places, g[places], lo, hi


def _first_pass(window: int, prefix: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1, 1_000_000):
            texts = part.column(1).to_pylist()
            hashes, counts = word_hashes(texts)
            digests = [hashlib.sha256(b" ".join(words_of(t))).digest() for t in texts]
            made, at = [], 0
            for n in counts.tolist():
                made.append(anchors(hashes[at : at + n], window, prefix))
                at += n
            bounds = pa.array(np.cumsum([0, *(len(m[0]) for m in made)]), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x).astype(np.uint64).view(np.int64).astype(t))) for x, t in zip(zip(*made), (np.int32, np.int64, np.int16, np.int16))]
            columns = [part.column(0), pa.array(counts), pa.array([d.hex() for d in digests]), pa.array([key_of(d) for d in digests], pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "sha", "key", "places", "anchors", "los", "his"])

    return run


FIRST = "doc_id long, n_words long, sha string, key long, places array<int>, anchors array<long>, los array<short>, his array<short>"
#: suffixes of a document under the prefix ``g``, for windows that begin lo to hi words before the anchor: words around the
#: anchor, ``left`` before and ``ahead`` from it on, as far as its own windows reach, and the runs of places (a window apart at most) that look so
CONTEXT = pa.schema([("g", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("left", pa.int32()), ("ahead", pa.int32()), ("words", pa.binary()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
CONTEXT_SQL = "g long, lo int, hi int, doc_id long, key long, left int, ahead int, words binary, begins array<int>, ends array<int>"


def pieces(lo: int, hi: int) -> list[tuple[int, int]]:
    """A range cut in four, or fewer where it has fewer numbers."""
    n = min(4, hi - lo + 1)
    cuts = [lo + (hi - lo + 1) * k // n for k in range(n + 1)]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:])]


def lengthened(words: list[bytes], at: int, a: int, b: int, lo: int, hi: int, window: int) -> tuple[int, int, int, bytes] | None:
    """(prefix hash, words before the anchor and from it on, words around it) of the suffix that begins ``lo`` words before the anchor at
    ``at``, for those of its windows, which begin a to b words before the anchor, that begin lo to hi words before it;
    None where there are none."""
    a, b = max(a, lo), min(b, hi)
    if a > b:
        return None
    prefix = hashlib.blake2b(b"%d %d " % (lo, hi) + b" ".join(words[at - lo : at + window - hi]), digest_size=8)
    return key_of(prefix.digest()), b, window - a, b" ".join(words[at - b : at + window - a])


def runs(places: list[int], apart: int) -> tuple[list[int], list[int]]:
    """First and last of each run of an ascending list's numbers that are ``apart`` at most.  With a window's length, what
    the windows around a run's places cover is one run of words."""
    begins = [p for k, p in enumerate(places) if not k or places[k - 1] + apart < p]
    ends = [p for k, p in enumerate(places) if k + 1 == len(places) or places[k + 1] > p + apart]
    return begins, ends


def _flushed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _contexts(window: int, prefix: int) -> Callable:
    """From (doc_id, key, text, marks): the suffixes of each marked anchor, under its own words or, where these are too
    frequent, under longer ones.  Equal ones of a document are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for doc, key, text, marks in zip(*[c.to_pylist() for c in batch.columns]):
                words = words_of(text)
                if key_of(hashlib.sha256(b" ".join(words)).digest()) != key:
                    continue  # another text of the same id
                found: dict[tuple, list[int]] = {}

                def flush(found=found, doc=doc, key=key):
                    for (g, lo, hi, *words_around), places in found.items():
                        out.append((g, lo, hi, doc, key, *words_around, *runs(places, window)))
                    found.clear()

                for m in sorted(marks, key=lambda m: m["place"]):
                    p, a, b, top = m["place"], m["a"], m["b"], window - prefix
                    if m["hot"]:
                        for lo, hi in pieces(0, top):
                            if x := lengthened(words, p, a, b, lo, hi, window):
                                found.setdefault((x[0], lo, hi, *x[1:]), []).append(p)
                                size += len(x[3]) + 60
                    else:
                        found.setdefault((m["h"], 0, top, b, window - a, b" ".join(words[p - b : p + window - a])), []).append(p)
                        size += 60 + 8 * window
                    if size > 4_000_000:
                        flush()
                        yield _flushed(out, CONTEXT)
                        out, size = [], 0
                flush()
        if out:
            yield _flushed(out, CONTEXT)

    return run


def _cut_in_pieces(window: int) -> Callable:
    """Suffixes under longer prefixes, for each piece of their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, lo, hi, doc, key, left, ahead, around, begins, ends in zip(*[c.to_pylist() for c in batch.columns]):
                words = around.split(b" ")
                for first, last in pieces(lo, hi):
                    if x := lengthened(words, left, window - ahead, left, first, last, window):
                        out.append((x[0], first, last, doc, key, *x[1:], begins, ends))
                if len(out) > 5_000:
                    yield _flushed(out, CONTEXT)
                    out = []
            if out:
                yield _flushed(out, CONTEXT)

    return run


def _sorted_lengths(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix tree of rows of word numbers: their order, and how many leading words each shares with the one before."""
    as_bytes = np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()
    order = np.argsort(as_bytes, kind="stable")
    same = rows[order[1:]] == rows[order[:-1]]
    return order, np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))


def repeats(docs: np.ndarray, left: np.ndarray, contexts: list[bytes], window: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that repeat a window of a smaller document, and how many words before the anchor such windows begin, at
    least and at most, of those that begin lo to hi words before it.

    ``contexts`` holds the words of a row's own windows: ``left`` before each anchor (``hi`` at most) and up to
    ``window - lo`` from it on.
    """
    n, ahead_of = len(docs), window - lo
    words = pc.split_pattern(pa.array(contexts, pa.binary()), " ")  # they are joined by one space, and hold no other
    flat = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    lengths = words.value_lengths().to_numpy()
    row = np.repeat(np.arange(n), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths) - left[row]
    top = int(flat.max(initial=0)) + 1
    fill = (top + np.arange(n))[:, None]  # where a document ends, a number of its own
    ahead, back = np.broadcast_to(fill, (n, ahead_of)).copy(), np.broadcast_to(fill, (n, hi)).copy()
    right = (column >= 0) & (column < ahead_of)
    ahead[row[right], column[right]] = flat[right]
    before = (column < 0) & (column >= -hi)
    back[row[before], -column[before] - 1] = flat[before]
    order_a, shared_a = _sorted_lengths(ahead)
    order_b, shared_b = _sorted_lengths(back) if hi else (np.arange(n), np.zeros(n - 1, np.int64))
    node_a, node_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    least_shift, most_shift = np.full(n, window), np.full(n, -1)
    for shift in range(lo, hi + 1):  # windows that begin ``shift`` words before the anchor
        node_a[order_a] = np.concatenate([[0], np.cumsum(shared_a < window - shift)])
        node_b[order_b] = np.concatenate([[0], np.cumsum(shared_b < shift)])
        _, node = np.unique(node_a * n + node_b, return_inverse=True)
        first = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, node, docs)
        hit = docs > first[node]
        least_shift[hit] = np.minimum(least_shift[hit], shift)
        most_shift[hit] = shift
    found = np.flatnonzero(most_shift >= 0)
    return found, least_shift[found], most_shift[found]


SPAN = "doc_id long, key long, begin int, end int"


def _trees(window: int) -> Callable:
    """Spans of repeated words from suffixes sorted by (lo, g), in whole groups of these."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        los = table.column("lo").to_numpy()
        for lo in np.unique(los).tolist():
            part = table.filter(pa.array(los == lo)) if (los != lo).any() else table
            docs, left = part.column("doc_id").to_numpy(), part.column("left").to_numpy().astype(np.int64)
            rows, least, most = repeats(docs, left, part.column("words").to_pylist(), window, lo, part.column("hi")[0].as_py())
            if not len(rows):
                continue
            hit = part.take(pa.array(rows)).combine_chunks()
            begins, ends = hit.column("begins").combine_chunks(), hit.column("ends").combine_chunks()
            of = np.repeat(np.arange(len(rows)), begins.value_lengths().to_numpy())
            # every such window holds its anchor, so those of a run of anchors cover one run of words
            begin, end = begins.flatten().to_numpy() - most[of], ends.flatten().to_numpy() + window - least[of]
            columns = [pa.array(hit.column("doc_id").to_numpy()[of]), pa.array(hit.column("key").to_numpy()[of]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            while held.num_rows >= CHUNK_ROWS:
                g, lo = held.column("g").to_numpy(), held.column("lo").to_numpy()
                borders = np.flatnonzero((g[1:] != g[:-1]) | (lo[1:] != lo[:-1])) + 1
                borders = borders[borders <= CHUNK_ROWS] if len(borders) and borders[0] <= CHUNK_ROWS else borders[:1]
                if not len(borders):
                    break  # the last group may go on
                yield from solve(held.slice(0, borders[-1]))
                held = held.slice(borders[-1])
        if held is not None and held.num_rows:
            yield from solve(held)

    return run


def covered(spans: list[dict], n: int) -> np.ndarray:
    """Which of n words the spans cover."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, [s["begin"] for s in spans], 1)
    np.add.at(steps, [s["end"] for s in spans], -1)
    return np.cumsum(steps[:-1]) > 0


def _cut(keep_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, key, text, spans in zip(*[c.to_pylist() for c in batch.columns]):
                words = words_of(text)
                if key_of(hashlib.sha256(b" ".join(words)).digest()) != key:
                    continue  # another text of the same id
                gone = covered(spans, len(words))
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out.append((doc, key, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "key", "removed", "kept_sha", "kept_text"])

    return run


def _spans_of(rows: DataFrame, window: int) -> DataFrame:
    return rows.select(*CONTEXT.names).repartition("lo", "g").sortWithinPartitions("lo", "g").mapInArrow(_trees(window), SPAN)


def without_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, group_rows: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]): one row per input row.

    Each word under a window of ``window`` words that also starts in a document with a smaller id is removed;
    windows are judged on the input.  Null and empty texts have no words; rows with a null id lose nothing and
    nothing is lost to them; rows that share an id are one document; ``kept_text`` joins kept words by one space
    (null where nothing was removed: the text is then as it was).
    """
    group_rows = group_rows or GROUP_ROWS
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = written(texts.mapInArrow(_first_pass(window, prefix), FIRST), "suffix-first")
    enough = first.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    distinct = enough.groupBy("sha").agg(F.min(F.struct("doc_id", "key")).alias("o"), F.count(F.lit(1)).alias("n"), F.first(F.struct("places", "anchors", "los", "his")).alias("a"))
    distinct = written(distinct.select("sha", "o.*", "n", "a.*"), "suffix-distinct")

    each = distinct.select("doc_id", "key", F.explode(F.arrays_zip("places", "anchors", "los", "his")).alias("a")).select("doc_id", "key", F.col("a.places").alias("place"), F.col("a.anchors").alias("h"), F.col("a.los").alias("a"), F.col("a.his").alias("b"))
    shared = each.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = written(shared.select("h", (F.col("n") > group_rows).alias("hot")), "suffix-shared")
    marks = each.join(shared, "h").groupBy("doc_id", "key").agg(F.collect_list(F.struct("h", "place", "hot", "a", "b")).alias("marks"))  # of one document
    texts_of = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = written(texts_of.join(marks, "doc_id").select("doc_id", "key", "text", "marks"), "suffix-marked")

    rows = written(marked.mapInArrow(_contexts(window, prefix), CONTEXT_SQL), "suffix-contexts")
    whole = F.col("hi") - F.col("lo") == window - prefix
    spans, split = _spans_of(rows.where(whole), window), rows.where(~whole)
    while split.limit(1).count():  # once for each length of prefixes, four times at most for windows of 50 words
        name = ["lo", "g", "h", "h2"]  # the same words around an anchor
        named = split.withColumn("h", F.xxhash64("left", "words")).withColumn("h2", F.xxhash64(F.lit(1), "words", "left"))
        firsts = written(named.groupBy(name).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "suffix-firsts")
        sizes = written(firsts.groupBy("lo", "g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "suffix-sizes")
        told = join_small(firsts, sizes, ["lo", "g"], how="left").where("m > 1 or first < last")
        each = written(join_small(named, written(told, "suffix-told"), name), "suffix-each")
        copies = each.where("doc_id > first").select("doc_id", "key", "left", "ahead", F.explode(F.arrays_zip("begins", "ends")).alias("r"))
        spans = spans.unionByName(copies.select("doc_id", "key", (F.col("r.begins") - F.col("left")).alias("begin"), (F.col("r.ends") + F.col("ahead")).alias("end")))
        own = each.where("doc_id = first and m > 1")
        spans = spans.unionByName(_spans_of(own.where(F.col("m") <= group_rows), window))
        more = own.where(F.col("m") > group_rows).select(*CONTEXT.names)
        split = written(more.mapInArrow(_cut_in_pieces(window), CONTEXT_SQL), "suffix-pieces")
    of_doc = spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))  # of one document
    touched = marked.drop("marks").join(of_doc, ["doc_id", "key"]).select("doc_id", "key", "text", "spans")
    cut = touched.mapInArrow(_cut(keep_text), "doc_id long, key long, removed long, kept_sha string, kept_text string").dropDuplicates(["doc_id", "key"])
    cut = written(cut, "suffix-cut")

    copies = written(distinct.where("n > 1").select("sha", F.col("doc_id").alias("_first")), "suffix-copies")
    slim = join_small(first.select("doc_id", "n_words", "sha", "key"), copies, ["sha"], how="left")
    out = slim.join(cut, ["doc_id", "key"], "left")
    again = F.coalesce((F.col("doc_id") > F.col("_first")) & (F.col("n_words") >= window), F.lit(False))
    columns = [
        "doc_id",
        "n_words",
        F.when(again, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(again, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    ]
    return out.select(*columns, *([F.when(again, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if keep_text else []))
