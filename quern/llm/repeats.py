"""Suffix-array dedup: removal of every byte that lies in a repeat of ``length`` bytes standing earlier.

A collection's suffix array cannot be sorted in one place, so the windows of ``length`` bytes are dealt out by content:
each goes to the least-hashed k-gram inside it (its minimizer), and neighbouring windows with one minimizer form a
segment.  Equal windows have equal minimizers, so they meet; the rest follows from that.

1. Minimizers that stand in one place only cannot hold a repeat.  Those that stand in two places set bits of a
   filter of fixed size; the other segments are never shuffled.
2. Equal segments collapse to the earliest, first inside each step of a task (so a frequent segment is one row a step),
   then by minimizer; the later ones are removed whole.
3. Different segments of one minimizer are aligned on it, and each is trimmed to the longest stretch that it can share with
   any other of them.  All that is left goes, together with other minimizers' segments, into a collection of bounded size, whose
   Burrows-Wheeler transform and common prefixes are built column by column (``bcr``).  Neighbouring rows with a common
   prefix of ``length`` or more are equal windows; all but the earliest are removed.  A minimizer with more than ``hot`` different
   segments is dealt out again, window by window, and its equal windows are matched by 128-bit content hashes, so no
   collection grows with a frequent passage.
4. The removed stretches of a document are united and cut out.

Order: smaller id first; rows that share an id are ordered by a hash of their text, and rows equal in both are
one document (each gets the same result).  Rows without an id come last.  A null text is empty; a text shorter than
``length`` loses nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bcr import repeated
from quern.llm.shingles import mix
from quern.llm.text_arrays import hash_filter, in_filter, steps
from quern.plans.shared import discard, free_shuffles, materialise, ship_package

#: Bytes of a minimizer: a power of two.
GRAM = 32
#: Bytes of text whose minimizers are sought at once.
PIECE = 1 << 16
#: Bits of the filter of repeated minimizers: a fixed 8 MB at any size of input.
FILTER_BITS = 1 << 26
#: Segment bytes of one collection (its arrays stay in a core's cache), and segments of one minimizer beyond which it is dealt
#: out by windows.
COLLECTION = 1 << 19
HOT = 10_000
_LAST = (1 << 63) - 1


def segments(raws: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, key, gram): runs of window starts that share a minimizer, a hash of that k-gram, and its place in the segment.

    Texts are taken in pieces of bounded size, so that a step's arrays stay in cache and a long text needs no more memory than others;
    runs that a cut divides are put together again.
    """
    found, held, size = [], [], 0
    for t, raw in enumerate(raws):
        for at in range(0, len(raw) - length + 1, PIECE):
            piece = raw[at : at + PIECE + length - 1]
            if held and size + len(piece) > PIECE:
                found.append(_runs(held, length))
                held, size = [], 0
            held.append((t, at, piece))
            size += len(piece)
    if not held:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found.append(_runs(held, length))
    text, start, windows, key, gram = (np.concatenate(c) for c in zip(*found))
    whole = np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] + gram[1:] != start[:-1] + gram[:-1])])
    if not whole.all():
        windows = np.add.reduceat(windows, np.flatnonzero(whole))
        text, start, key, gram = text[whole], start[whole], key[whole], gram[whole]
    return text, start, windows, key, gram


def _runs(pieces: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """``segments`` of pieces (text, offset, bytes), each of ``length`` bytes or more."""
    sizes = np.fromiter((len(p) for _, _, p in pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    h = np.frombuffer(b"".join([p for _, _, p in pieces]), np.uint8).astype(np.uint64)
    h += np.uint64(1)
    span, power = 1, 0x9E3779B97F4A7C15
    while span < GRAM:
        longer = h[:-span] * np.uint64(power)
        longer += h[span:]
        h = longer
        power = power * power % (1 << 64)
        span *= 2
    h = mix(h)
    # hash above place: the minimum is the least hash, the leftmost of equals
    least = h & ~np.uint64((1 << 28) - 1)
    least |= np.arange(len(h), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    # windows that reach beyond their piece belong to none
    valid = np.ones(len(least) + 1, bool)
    for e in ends[:-1].tolist():
        valid[e - length + 1 : e] = False
    valid[-1] = False
    first = valid[:-1].copy()
    first[1:] &= ~valid[:-2] | (least[1:] != least[:-1])
    begin = np.flatnonzero(first)
    # a run ends where the next begins, or where its piece does
    own = np.searchsorted(ends, begin, side="right")
    windows = np.minimum(np.append(begin[1:], len(least)), ends[own] - length + 1) - begin
    gram = (least[begin] & np.uint64((1 << 28) - 1)).astype(np.int64)
    text, offset = np.array([t for t, _, _ in pieces], np.int64), np.array([a for _, a, _ in pieces], np.int64)
    return text[own], begin - (ends - sizes)[own] + offset[own], windows, h[gram], gram - begin


def _raws(part: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def _text_hash(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


def _keys_pass(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", 4 << 20):
                keys, counts = np.unique(segments(_raws(part), length)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.minimum(counts, 2), pa.int64())], names=["key", "n"])

    return run


def _place_hash(doc: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(np.uint64) + np.uint64(77)) ^ text.astype(np.uint64) ^ mix(start.astype(np.uint64)))


def _located(part: pa.RecordBatch, length: int, bits: np.ndarray):
    """Texts and, of the segments whose minimizers are in the filter, text, start, windows, key, gram, id and text hash."""
    raws = _raws(part)
    text, start, windows, key, gram = segments(raws, length)
    some = np.flatnonzero(in_filter(bits, key))
    text, start, windows, key, gram = text[some], start[some], windows[some], key[some], gram[some]
    hashes = np.zeros(len(raws), np.int64)
    for t in np.unique(text).tolist():
        hashes[t] = _text_hash(raws[t])
    ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    return raws, text, start, windows, key, gram, ids[text], hashes[text]


def _segments_pass(length: int, sent):
    """Earliest segments of each step (stop null), and the stretches that later equal ones take up (key null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        names = ["key", "sid", "doc_id", "text_hash", "start", "windows", "stop"]
        for batch in batches:
            for part in steps(batch, "text", 4 << 20):
                raws, text, start, windows, key, _, doc, hashes = _located(part, length, bits)
                if not len(text):
                    continue
                sid = np.fromiter((xxhash.xxh3_64_intdigest(raws[t][a : a + w + length - 1]) for t, a, w in zip(text.tolist(), start.tolist(), windows.tolist())), np.uint64, len(text))
                order = np.lexsort([start, hashes, doc, sid, key])
                again = np.zeros(len(order), bool)
                again[1:] = (key[order[1:]] == key[order[:-1]]) & (sid[order[1:]] == sid[order[:-1]])
                first, later = order[~again], order[again]
                yield pa.RecordBatch.from_arrays([pa.array(key[first].astype(np.int64)), pa.array(sid[first].astype(np.int64)), pa.array(doc[first]), pa.array(hashes[first]), pa.array(start[first]), pa.array(windows[first]), pa.nulls(len(first), pa.int64())], names=names)
                spans = _united(pd.DataFrame({"doc_id": doc[later], "text_hash": hashes[later], "start": start[later], "stop": start[later] + windows[later] + (length - 1)}))
                n = len(spans)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(spans["doc_id"]), pa.array(spans["text_hash"]), pa.array(spans["start"]), pa.nulls(n, pa.int64()), pa.array(spans["stop"])], names=names)

    return run


def _classes_pass(length: int, hot: int):
    """Rows sorted by key, sid and place -> stretches of copies; places (windows set, stop null) of different segments; hot keys (only the key set)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kinds, held, told = None, 0, None, False  # held: a key's first segment, until another kind of it comes
        for f in frames:
            key, sid = f["key"].to_numpy(), f["sid"].to_numpy()
            if not len(f):
                continue
            same_key = np.concatenate([[last is not None and last[0] == key[0]], key[1:] == key[:-1]])
            same = same_key & np.concatenate([[last is not None and last[1] == sid[0]], sid[1:] == sid[:-1]])
            fresh = f[~same]
            copies = f[same]
            if len(copies):
                yield pd.DataFrame({"key": copies["key"], "doc_id": copies["doc_id"], "text_hash": copies["text_hash"], "start": copies["start"], "windows": None, "stop": copies["start"] + copies["windows"] + (length - 1)})
            out = fresh[["key", "doc_id", "text_hash", "start", "windows"]]
            if len(fresh):
                k = fresh["key"].to_numpy()
                edges = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
                sizes = np.diff(edges)
                going_on = bool(same_key[~same][0])
                if held is not None and going_on:
                    out = pd.concat([held, out], ignore_index=True)
                    edges = np.concatenate([[0], edges[1:] + len(held)])
                    sizes = np.diff(edges)
                    kinds -= len(held)
                alone = sizes == 1
                if going_on and (held is None):
                    alone[0] = False  # its earlier kinds are out already
                counts = sizes.copy()
                if going_on:
                    counts[0] += kinds
                else:
                    told = False
                for i in np.flatnonzero(counts > hot):
                    if not (i == 0 and told):
                        yield pd.DataFrame({"key": [out["key"].iloc[edges[i]]], "doc_id": None, "text_hash": None, "start": None, "windows": None, "stop": None})
                if len(sizes) > 1:
                    told = False
                told = told or counts[-1] > hot
                kinds = int(counts[-1])
                keep = np.repeat(~alone, sizes)
                held = None
                if alone[-1]:
                    held = out.iloc[-1:]
                yield out[keep].assign(stop=None)
            last = (key[-1], sid[-1])

    return run


def _bytes_pass(length: int, keys, places):
    """Bytes of the segments whose places are in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, chosen = np.frombuffer(keys.value, np.uint8), np.frombuffer(places.value, np.uint8)
        for batch in batches:
            for part in steps(batch, "text", 4 << 20):
                raws, text, start, windows, key, gram, doc, hashes = _located(part, length, bits)
                some = np.flatnonzero(in_filter(chosen, _place_hash(doc, hashes, start)))
                pieces = [raws[t][a : a + w + length - 1] for t, a, w in zip(text[some].tolist(), start[some].tolist(), windows[some].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(key[some].astype(np.int64)), pa.array(doc[some]), pa.array(hashes[some]), pa.array(start[some]), pa.array(gram[some]), pa.array(pieces, pa.binary())], names=["key", "doc_id", "text_hash", "start", "gram", "bytes"])

    return run


def _shared_reach(key: np.ndarray, contexts: list[bytes], width: int) -> np.ndarray:
    """For each row, the longest prefix of its context that another row of the same key has too."""
    n = len(contexts)
    wide = np.frombuffer(b"".join([k.tobytes() + c.ljust(width, b"\0") for k, c in zip(key.astype(">u8"), contexts)]), f"V{width + 8}")
    order = np.argsort(wide.view(f"S{width + 8}"), kind="stable")
    flat = wide.view(np.uint8).reshape(n, width + 8)[order]
    size = np.fromiter(map(len, contexts), np.int64, n)[order]
    differ = flat[1:] != flat[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width + 8) - 8
    common = np.minimum(np.minimum(common, size[1:]), size[:-1])
    best = np.zeros(n, np.int64)
    best[1:] = np.maximum(best[1:], common)
    best[:-1] = np.maximum(best[:-1], common)
    out = np.empty(n, np.int64)
    out[order] = np.maximum(best, 0)
    return out


def _collections_pass(length: int):
    """Rows sorted by key, whole keys together in collections of bounded size -> removed stretches."""

    def solve(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key, gram, raw = rows["key"].to_numpy(), rows["gram"].to_numpy(), rows["bytes"].tolist()
        doc, text, start = (rows[c].to_numpy() for c in ("doc_id", "text_hash", "start"))
        right = _shared_reach(key, [b[g:] for b, g in zip(raw, gram.tolist())], length + 1)
        # what stands before the minimizer cannot make up for too short a share after it
        able = np.flatnonzero(gram + right >= length)
        if not len(able):
            return
        left = np.zeros(len(raw), np.int64)
        left[able] = _shared_reach(key[able], [raw[i][: gram[i]][::-1] for i in able.tolist()], length + 1)
        some = able[left[able] + right[able] >= length]
        if not len(some):
            return
        begin = (gram - left)[some]
        pieces = [raw[i][a : g + r] for i, a, g, r in zip(some.tolist(), begin.tolist(), gram[some].tolist(), right[some].tolist())]
        doc, text, at = doc[some], text[some], start[some] + begin
        group, string, offset = repeated(pieces, length)
        doc, text, at = doc[string], text[string], at[string] + offset
        order = np.lexsort([at, text, doc, group])
        again = order[1:][group[order[1:]] == group[order[:-1]]]
        if len(again):
            yield _united(pd.DataFrame({"doc_id": doc[again], "text_hash": text[again], "start": at[again], "stop": at[again] + length}))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            if not len(frame):
                continue
            size += int(frame["bytes"].map(len).sum())
            held.append(frame)
            if size > COLLECTION:
                whole = pd.concat(held, ignore_index=True)
                k = whole["key"].to_numpy()
                cut = int(np.flatnonzero(k == k[-1])[0])  # the last key may go on
                if cut:
                    yield from solve(whole.iloc[:cut])
                held = [whole.iloc[cut:]]
                size = int(held[0]["bytes"].map(len).sum())
        if held:
            yield from solve(pd.concat(held, ignore_index=True))

    return run


def _united(spans: pd.DataFrame) -> pd.DataFrame:
    """Overlapping or touching stretches of one document as one."""
    if not len(spans):
        return spans
    spans = spans.sort_values(["doc_id", "text_hash", "start"], kind="stable")
    doc, text, start, stop = (spans[c].to_numpy() for c in ("doc_id", "text_hash", "start", "stop"))
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])
    # ends so far inside each document: documents are set apart by a step larger than any end
    step = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + np.cumsum(new) * step) - np.cumsum(new) * step
    fresh = new.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(spans)) - 1
    return pd.DataFrame({"doc_id": doc[first], "text_hash": text[first], "start": start[first], "stop": reach[last]})


def _windows_pass(length: int):
    """Segments of frequent minimizers -> their windows' content hashes and places."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 500):
                f = frame.iloc[at : at + 500]
                if not len(f):
                    continue
                n = f["bytes"].map(len).to_numpy() - length + 1
                flat = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p[i : i + length]) for p in f["bytes"] for i in range(len(p) - length + 1)), "<i8").reshape(-1, 2)
                shift = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"w1": flat[:, 0], "w2": flat[:, 1], "doc_id": np.repeat(f["doc_id"].to_numpy(), n), "text_hash": np.repeat(f["text_hash"].to_numpy(), n), "start": np.repeat(f["start"].to_numpy(), n) + shift})

    return run


def _cut_pass(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        spans_out, kept = [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            raw = text or b""
            united: list[list[int]] = []
            for s in sorted((s["start"], s["stop"]) for s in spans or []):
                if united and s[0] <= united[-1][1]:
                    united[-1][1] = max(united[-1][1], s[1])
                else:
                    united.append([*s])
            at, parts = 0, []
            for a, b in united:
                parts.append(raw[at:a])
                at = b
            kept.append(b"".join([*parts, raw[at:]]))
            spans_out.append([{"start": a, "stop": b} for a, b in united])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text").cast(pa.binary())], pa.int64()), pa.array(spans_out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"]
        )


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, spans (removed stretches, united, in order), kept (the remaining bytes)."""
    spark = docs.sparkSession
    ship_package(spark)
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    n_parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(_LAST)))

    twice = texts.select("text").mapInArrow(_keys_pass(length), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    keys = hash_filter(twice, FILTER_BITS)
    noted = materialise(named.mapInArrow(_segments_pass(length, keys), "key long, sid long, doc_id long, text_hash long, start long, windows long, stop long"), "repeat-segments")
    sorted_ = noted.filter("key IS NOT NULL").drop("stop").repartition(n_parts, "key").sortWithinPartitions("key", "sid", "doc_id", "text_hash", "start")
    classes = materialise(sorted_.mapInPandas(_classes_pass(length, hot), "key long, doc_id long, text_hash long, start long, windows long, stop long"), "repeat-classes")

    apart = classes.filter("windows IS NOT NULL")
    hashed = "key long"

    def hash_places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": _place_hash(*(f[c].to_numpy(np.int64) for c in ("doc_id", "text_hash", "start"))).astype(np.int64)})

    places = hash_filter(apart.select("doc_id", "text_hash", "start").mapInPandas(hash_places, hashed), FILTER_BITS)
    pieces = named.mapInArrow(_bytes_pass(length, keys, places), "key long, doc_id long, text_hash long, start long, gram long, bytes binary")
    frequent_keys = classes.filter("doc_id IS NULL").select("key").distinct().withColumn("frequent", F.lit(True))
    pieces = materialise(pieces.join(frequent_keys, "key", "left"), "repeat-pieces")
    dealt = pieces.filter("frequent IS NULL").drop("frequent").repartition(n_parts, "key").sortWithinPartitions("key")
    span = "doc_id long, text_hash long, start long, stop long"
    solved = dealt.mapInPandas(_collections_pass(length), span)

    place = F.struct("doc_id", "text_hash", "start")
    windows = pieces.filter("frequent").select("doc_id", "text_hash", "start", "bytes").mapInPandas(_windows_pass(length), "w1 long, w2 long, doc_id long, text_hash long, start long")
    earliest = windows.groupBy("w1", "w2").agg(F.min(place).alias("at"), F.count("*").alias("n")).filter("n > 1").select("w1", "w2", "at")
    frequent = windows.join(earliest, ["w1", "w2"]).filter(place != F.col("at")).select("doc_id", "text_hash", "start", (F.col("start") + length).alias("stop"))

    known = [t.filter("stop IS NOT NULL").select("doc_id", "text_hash", "start", "stop") for t in (noted, classes)]
    spans = materialise(known[0].union(known[1]).union(solved).union(frequent), "repeat-spans")
    for spent in (noted, classes, pieces):
        discard(spent)
    free_shuffles(spark)
    per_doc = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    listed = _with_spans(texts, per_doc)
    return listed.mapInArrow(_cut_pass, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def _with_spans(texts: DataFrame, per_doc: DataFrame) -> DataFrame:
    """texts with the stretches of each, matched by id and by a hash of the text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_text_hash(r) for r in raws], pa.int64())], names=["doc_id", "text", "text_hash"])

    keyed = texts.mapInArrow(hashed, "doc_id long, text string, text_hash long").withColumn("own", F.coalesce("doc_id", F.lit(_LAST)))
    joined = keyed.join(per_doc.select(F.col("doc_id").alias("own"), "text_hash", "spans"), ["own", "text_hash"], "left")
    return joined.select("doc_id", "text", "spans")
