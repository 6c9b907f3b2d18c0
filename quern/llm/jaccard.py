"""N-gram Jaccard join of whole texts with count-vector R-trees.

Shingles are hashed into groups; a text's group counts are a point, and the sum of coordinate minima bounds the overlap
of two texts.  One tree over all texts would sit in one task, so the points are dealt to many small trees by an exact
rule: texts of sizes that may link are cut into more groups than they may differ in (by a fifth), so linked texts agree
wholly on as many groups as there are more, less those that are empty, and meet under their keys.  (A text with as many
empty groups as that is filed under those too, so nothing is lost.)

1. Texts with equal shingle sets collapse into one class.
2. Keys held by two classes or more make blocks; everything else is dropped unseen.  A class that must meet its partners under
   r keys leaves its r - 1 commonest ones, in an order that is one for all: of r common keys the rarest stays with both
   partners.  So a line that many unlike texts share makes no large block, and a class that meets others under fewer keys
   than r is left out.  What stays is the trees' blocks.
3. Every block gets an R-tree, joined with itself: node pairs whose summed minima cannot reach the similarity are left out.
   Of the pairs that survive, only those leave that would tie the block's classes together, so a block of n classes gives
   n - 1 pairs at most; they are verified on the exact sets.  A large block is searched for a few classes first, and nodes
   whose classes are tied by then are not compared: a group of near copies costs a few searches, not its square.
4. Where classes of a block are still apart and further pairs survived, the block gets their exact sets and verifies pairs
   in turn while their ends are apart.
5. Connected components of all verified links.

Edge cases: a null text or one without words has an empty set and links with nothing; a text of fewer words is one
shingle; ids that are null link with nothing (in ``jaccard_groups`` they are rows like others); rows that share an id
are rows of their own, each with its text's links; an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.llm.rtree import CountRTree
from quern.llm.shingles import mix, shingle_sets
from quern.llm.text_arrays import hash_filter, in_filter, steps
from quern.plans.shared import discard, free_shuffles, materialise, ship_package

#: Groups of a point.
GROUPS = 1024
#: Classes in one tree at most; a block of more is cut into pairs of parts.
BLOCK = 16384
#: Classes of a block up to which all its surviving pairs are listed; larger ones are tied on the way.
LISTED = 64
#: Classes whose exact sets are put together at most.
TOGETHER = 1024
#: Surviving pairs of a tree that are taken before those tied by now are dropped.
TRIES = 4096
#: Bits of the filter that says which classes have a partner: a fixed 4 MB at any size of input.
FILTER_BITS = 1 << 25
#: Classes each task remembers, so that copies file their keys once a task.
SEEN = 200_000


def size_bands(num: int, den: int, top: int) -> np.ndarray:
    """Lowest sizes of the bands: only sets of one band or of neighbouring bands can reach num/den."""
    bands = [1]
    while bands[-1] <= top:
        bands.append(bands[-1] * den // num + 1)
    return np.array(bands, np.int64)


def band_groups(bands: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For each band: the most that two sets meeting there may differ in, and the number of groups to cut them into."""
    most = np.concatenate([bands[1:] - 1, [bands[-1] * den // num]])
    differ = 2 * most * (den - num) // (den + num)
    return differ, differ + 3 + differ // 5


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set, alike for equal sets; 0 for empty ones."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some] = mix(np.add.reduceat(mix(hashes), starts) + sizes[some].astype(np.uint64))
    return out


def group_keys(hashes: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, need) of all sets: linked sets meet under ``need`` keys at least that are alike in their lowest bit.

    That bit tells the two bands apart in which a set is filed.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return none
    n = sizes[some]
    bands = size_bands(num, den, int(n.max()) * den // num + 1)
    differ, groups = band_groups(bands, num, den)
    member = np.repeat(np.arange(len(some)), n)
    once = mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    low, high = (once & np.uint64(0x3FFFFFF)).astype(np.float64), ((once >> np.uint64(26)) & np.uint64(0x3FFFFFF)).astype(np.float64)
    rows, keys, needs = [], [], []
    for up in (0, 1):
        tag = np.searchsorted(bands, n, side="right") - 1 + up
        m = np.where(differ[tag] > 0, groups[tag], 0)  # sets that may not differ are one class already
        base = np.cumsum(m) - m
        total = int(m.sum())
        if not total:
            continue
        used = m[member] > 0
        place = base[member[used]] + ((hashes[used] >> np.uint64(20)) % m[member[used]].astype(np.uint64)).astype(np.int64)
        held = np.bincount(place, minlength=total)
        sums = np.bincount(place, low[used], total).astype(np.uint64), np.bincount(place, high[used], total).astype(np.uint64)
        owner = np.repeat(np.arange(len(some)), m)
        group = (np.arange(total) - base[owner]).astype(np.uint64)
        empty = np.bincount(owner, held == 0, len(some))
        agreed = m - differ[tag]
        filed = (held > 0) | (empty >= agreed)[owner]
        key = mix(mix(sums[0] + (sums[1] << np.uint64(26)) + np.uint64(1)) ^ (group * np.uint64(0x9E3779B97F4A7C15) + tag[owner].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (held.astype(np.uint64) << np.uint64(3))))
        key = (key & ~np.uint64(1)) | (tag & 1).astype(np.uint64)[owner]
        rows.append(some[owner[filed]])
        keys.append(key[filed])
        needs.append(np.maximum(agreed - empty, 1).astype(np.int64)[owner[filed]])
    return (np.concatenate(rows), np.concatenate(keys), np.concatenate(needs)) if rows else none


def _raws(part: pa.RecordBatch) -> list[bytes]:
    return [(t or b"").lower() for t in part.column("text").cast(pa.binary()).to_pylist()]


def points_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Members of each set by group, one row a set, as narrow as the counts allow."""
    member = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(member * GROUPS + (hashes & np.uint64(GROUPS - 1)).astype(np.int64), minlength=len(sizes) * GROUPS).reshape(-1, GROUPS)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32)


def _packed(point: np.ndarray) -> bytes:
    """One byte a group where counts allow, else four."""
    return point.astype("u1" if point.max() < 256 else "<u4").tobytes()


def _points(packed: list[bytes]) -> np.ndarray:
    """Rows of counts, as narrow as they allow."""
    if all(len(p) == GROUPS for p in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), GROUPS)
    return np.stack([np.frombuffer(p, np.uint8 if len(p) == GROUPS else "<u4").astype(np.uint32) for p in packed])


def _sizes_pass(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                hashes, sizes = shingle_sets(_raws(part), words)
                points = pa.array([_packed(p) for p in points_of(hashes, sizes)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(sizes, pa.int64()), pa.array(signatures(hashes, sizes).astype(np.int64), pa.int64()), points], names=["doc_id", "mark", "n", "sig", "point"])

    return run


def _keys_pass(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in steps(batch, "text"):
                hashes, sizes = shingle_sets(_raws(part), words)
                sigs = signatures(hashes, sizes)
                fresh = np.zeros(len(sizes), bool)
                for i, s in enumerate(sigs.tolist()):
                    if s and s not in seen:
                        fresh[i] = True
                        seen.add(s)
                if len(seen) > SEEN:
                    seen.clear()
                rows, keys, needs = group_keys(hashes[np.repeat(fresh, sizes)], np.where(fresh, sizes, 0), num, den)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sigs[rows].astype(np.int64)), pa.array(needs)], names=["key", "sig", "need"])

    return run


def _blocks_pass(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (key, sig) -> blocks of two classes or more; equal blocks of one band have one gid, and a number of keys."""

    def close(key: np.ndarray, sig: np.ndarray, need: np.ndarray) -> pd.DataFrame:
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])])
        key, sig, need = key[fresh], sig[fresh], need[fresh]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        gid = mix(np.add.reduceat(mix(sig.astype(np.uint64)), starts) + sizes.astype(np.uint64) * np.uint64(2) + (key[starts] & 1).astype(np.uint64)).astype(np.int64)
        many = np.flatnonzero(sizes > 1)
        _, at, keys = np.unique(gid[many], return_index=True, return_counts=True)
        many = many[at]
        rows = np.repeat(starts[many] - (np.cumsum(sizes[many]) - sizes[many]), sizes[many]) + np.arange(int(sizes[many].sum()))
        each = lambda x: np.repeat(x, sizes[many])
        return pd.DataFrame({"gid": each(gid[many]), "sig": sig[rows], "band": key[rows] & 1, "need": need[rows], "size": each(sizes[many]), "keys": each(keys)})

    held = [np.zeros(0, np.int64)] * 3
    for f in frames:
        held = [np.concatenate([x, f[c].to_numpy()]) for x, c in zip(held, ("key", "sig", "need"))]
        key = held[0]
        if len(key) > 200_000:
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut:
                yield close(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
    if len(held[0]):
        yield close(*held)


def rarest(met: DataFrame) -> DataFrame:
    """Blocks -> (gid, sig) without each class's need - 1 commonest keys of a band; equal blocks have one gid."""
    met = met.groupBy("gid", "sig", "band").agg(F.first("need").alias("need"), F.first("size").alias("size"), F.sum("keys").alias("keys"))
    common = Window.partitionBy("sig", "band").orderBy(F.desc("size"), "gid").rowsBetween(Window.unboundedPreceding, 0)
    kept = materialise(met.withColumn("upto", F.sum("keys").over(common)).filter("upto >= need").select("gid", "sig"), "jaccard-rarest")
    listed = F.struct(F.count("*").alias("n"), *(F.sum(F.xxhash64("sig", F.lit(salt)).cast("decimal(38,0)")).alias(f"h{salt}") for salt in (1, 2)))
    once = kept.groupBy("gid").agg(listed.alias("listed")).filter("listed.n > 1").groupBy("listed").agg(F.min("gid").alias("gid"))
    blocks = materialise(kept.join(once, "gid").select("gid", "sig"), "jaccard-blocks")
    discard(kept)
    return blocks


def _sets_pass(words: int, filter_):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(filter_.value, np.uint8), set()
        for batch in batches:
            for part in steps(batch, "text"):
                hashes, sizes = shingle_sets(_raws(part), words)
                sigs = signatures(hashes, sizes)
                asked = (sizes > 0) & in_filter(bits, sigs)
                ends = np.cumsum(sizes)
                rows = []
                for i in np.flatnonzero(asked):
                    if int(sigs[i]) not in seen:
                        seen.add(int(sigs[i]))
                        rows.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                sets = [hashes[ends[i] - sizes[i] : ends[i]].tobytes() for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(sigs[rows].astype(np.int64), pa.int64()), pa.array(sets, pa.binary())], names=["sig", "members"])

    return run


def _reaches(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared * den >= num * (len(x) + len(y) - shared)


def _apart(pairs: np.ndarray, across: np.ndarray | None) -> np.ndarray:
    return pairs if across is None else pairs[across[pairs[:, 0]] != across[pairs[:, 1]]]


def forest(pairs: np.ndarray, n: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Of the pairs of n rows, in their order, those that tie rows not tied yet; the first row of each row's tie; and whether
    other pairs are left among the rows of a tie."""
    root, taken, tried = np.arange(n), [], len(pairs)
    rows, more = pairs[:, 0], np.zeros(n, bool)
    while len(pairs):
        for a, b in pairs[:TRIES].tolist():
            x, y = int(root[a]), int(root[b])
            if x != y:
                taken.append((a, b))
                root[root == max(x, y)] = min(x, y)
        pairs = pairs[TRIES:]
        pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
    if tried > len(taken):
        size = np.bincount(root, minlength=n)
        more = (np.bincount(root[rows], minlength=n) >= size)[root] & (size > 1)[root]
    return taken, root, more


def tying_links(sets: list[np.ndarray], labels: np.ndarray, num: int, den: int, across: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified pairs that tie sets of different labels together, at most one for every label fewer.

    The tree's surviving pairs are taken in turn; a pair is verified only while its ends are apart, so a group of near copies
    costs about one verification a member.  across: parts of the sets; only pairs of different parts are looked at.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, root = np.unique(labels, return_inverse=True)
    return CountRTree(points_of(np.concatenate(sets), sizes), sizes).tie(num, den, root, across, lambda a, b: _reaches(sets[a], sets[b], num, den))


def _spans(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], int, int]]:
    """(columns, start, stop) of each group of two rows or more, from frames that arrive sorted by keys."""
    held: list[pd.DataFrame] = []

    def spans(whole: pd.DataFrame, last: bool):
        k = whole[keys].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]]).tolist()
        ready = edges if last else edges[:-1]
        columns = {c: whole[c].to_numpy() for c in whole.columns}
        return [(columns, a, b) for a, b in zip(ready, ready[1:]) if b - a > 1], whole.iloc[edges[-2] :]

    for frame in frames:
        if len(frame):
            now = frame[keys].iloc[-1].tolist()
            same = held and held[0][keys].iloc[0].tolist() == now  # the group goes on
            held.append(frame)
            if not same or len(held) == 1:
                found, rest = spans(pd.concat(held, ignore_index=True), False)
                yield from found
                held = [rest]
    if held:
        yield from spans(pd.concat(held, ignore_index=True), True)[0]


def _trees_pass(num: int, den: int):
    """Cells of blocks -> pairs (b set) that would tie their classes together if verified, smallest signatures first so that
    blocks of one cluster name the same pairs; and, by tie, the classes (b null) among which further pairs are left to try."""
    names = ["gid", "i", "j", "own", "tie", "a", "b"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[list[np.ndarray]] = []
        size = 0

        def made() -> pd.DataFrame:
            columns = dict(zip(names, map(np.concatenate, zip(*out))))
            columns["b"] = pd.arrays.IntegerArray(columns["b"], columns["tie"] != 0)
            return pd.DataFrame(columns)

        for f, x, y in _spans(frames, ["gid", "i", "j"]):
            sigs, own = f["sig"][x:y], f["own"][x:y]  # signatures are in order inside a cell
            gid, i, j = f["gid"][x], f["i"][x], f["j"][x]
            tree, across = CountRTree(_points(f["point"][x:y].tolist()), f["n"][x:y]), own if i != j else None
            if y - x <= LISTED:
                pairs = np.sort(_apart(tree.self_join(num, den), across), axis=1)
                ties, root, more = forest(pairs[np.lexsort([pairs[:, 1], pairs[:, 0]])], y - x)
            else:
                root = np.arange(y - x)
                ties = tree.tie(num, den, root, across)
                more = np.bincount(root, minlength=y - x)[root] > 2  # not all pairs were looked at
            if not ties:
                continue
            ends, left = np.array(ties), np.flatnonzero(more)
            n = len(ends) + len(left)
            none = np.zeros(len(ends), np.int64)
            # ties are named from 1: 0 marks the pairs
            out.append([np.full(n, gid), np.full(n, i), np.full(n, j), np.concatenate([none, own[left]]), np.concatenate([none, root[left] + 1]), np.concatenate([sigs[ends[:, 0]], sigs[left]]), np.concatenate([sigs[ends[:, 1]], np.zeros(len(left), np.int64)])])
            size += n
            if size > 20_000:
                yield made()
                out, size = [], 0
        if out:
            yield made()

    return run


def _rest_pass(num: int, den: int):
    """Ties with the sets of their classes -> verified links."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, x, y in _spans(frames, ["gid", "i", "j", "tie"]):
            sigs, sets = f["sig"][x:y], [np.frombuffer(m, np.uint64) for m in f["members"][x:y]]
            links = tying_links(sets, f["component"][x:y], num, den, f["own"][x:y] if f["i"][x] != f["j"][x] else None)
            if links:
                ends = np.array(links)
                yield pd.DataFrame({"a": sigs[ends[:, 0]], "b": sigs[ends[:, 1]]})

    return run


def _verify_pass(num: int, den: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = [_reaches(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(f["ma"], f["mb"])]
            yield f.loc[np.array(ok, bool), ["a", "b"]]

    return run


def jaccard_groups(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", mark_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, mark (a column of longs that is carried along), n (set size), group.

    group is alike for rows that are linked, directly or through others, and null for empty sets.  Every row is a node of
    its own, whatever its id.
    """
    spark = docs.sparkSession
    ship_package(spark)
    n_parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mark = F.col(mark_col).cast("long") if mark_col else F.lit(None).cast("long")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), mark.alias("mark"), F.col(text_col).alias("text"))
    sized = materialise(texts.mapInArrow(_sizes_pass(words), "doc_id long, mark long, n long, sig long, point binary"), "jaccard-sizes")

    keyed = texts.select("text").mapInArrow(_keys_pass(words, num, den), "key long, sig long, need long")
    shape = "gid long, sig long, band long, need long, size long, keys long"
    blocks = rarest(keyed.repartition(n_parts, "key").sortWithinPartitions("key", "sig").mapInPandas(_blocks_pass, shape))
    points = materialise(sized.filter("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("point").alias("point")), "jaccard-points")
    free_shuffles(spark)

    def sets_of(asked: DataFrame, name: str) -> DataFrame:
        """Exact sets of the classes asked for: one pass over the texts behind a filter of fixed size."""
        sent = hash_filter(asked.select(F.col("sig").alias("key")), FILTER_BITS)
        found = texts.select("text").mapInArrow(_sets_pass(words, sent), "sig long, members binary")
        sets = materialise(found.dropDuplicates(["sig"]).join(asked, "sig", "left_semi"), name)
        free_shuffles(spark)
        return sets

    cells = blocks.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = blocks.join(cells, "gid").withColumn("own", F.pmod(F.xxhash64("sig"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("gid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sig").join(points, "sig")
    shape = "gid long, i int, j int, own int, tie int, a long, b long"
    joined = materialise(dealt.repartition(n_parts, "gid", "i", "j").sortWithinPartitions("gid", "i", "j", "sig").mapInPandas(_trees_pass(num, den), shape), "jaccard-joined")
    near = materialise(joined.filter("b IS NOT NULL").select("a", "b").distinct(), "jaccard-near")
    discard(blocks)
    discard(points)
    free_shuffles(spark)
    asked = materialise(near.select(F.col("a").alias("sig")).union(near.select("b")).distinct(), "jaccard-asked")
    sets = sets_of(asked, "jaccard-sets")
    a, b = (sets.select(F.col("sig").alias(side), F.col("members").alias(f"m{side}")) for side in ("a", "b"))
    links = materialise(near.join(a, "a").join(b, "b").mapInPandas(_verify_pass(num, den), "a long, b long"), "jaccard-tied")
    parts = connected_components(links)

    # ties whose classes are still apart, and not all of whose pairs were tried, get their sets: together if they are small
    # enough with all that they are tied to, else block by block (ties of one list of classes once)
    cell = ["gid", "i", "j", "tie"]
    ties = connected_components(near)
    sizes = ties.groupBy("component").agg(F.count("*").alias("size"))
    ties = ties.join(sizes, "component").select(F.col("id").alias("sig"), F.when(F.col("size") <= min(BLOCK, TOGETHER), F.col("component")).alias("small"))
    left = joined.filter("b IS NULL").select(*cell, "own", F.col("a").alias("sig")).join(ties, "sig")
    known = materialise(left.join(parts.select(F.col("id").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig")), "jaccard-known")
    whole = lambda name: F.lit(0).alias(name)
    small = known.filter("small IS NOT NULL").select(F.col("small").alias("gid"), whole("i"), whole("j"), whole("tie"), whole("own"), "sig", "component").distinct()
    small = small.join(small.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("gid"), "gid", "left_semi")
    large = known.filter("small IS NULL").drop("small")
    listed = F.struct(F.count("*").alias("n"), *(F.sum(F.xxhash64("sig", F.when(F.col("i") != F.col("j"), F.col("own")), F.lit(salt)).cast("decimal(38,0)")).alias(f"h{salt}") for salt in (1, 2)))
    open_ = large.groupBy(*cell).agg(F.min("component").alias("low"), F.max("component").alias("high"), listed.alias("listed")).filter("low <> high")
    open_ = open_.groupBy("listed").agg(F.min(F.struct(*cell)).alias("cell")).select("cell.*")
    still = materialise(large.join(open_, cell).select(*cell, "own", "sig", "component").union(small.select(*cell, "own", "sig", "component")), "jaccard-open").join(sets, "sig")
    more = materialise(still.repartition(n_parts, *cell).sortWithinPartitions(*cell, "sig").mapInPandas(_rest_pass(num, den), "a long, b long"), "jaccard-more")
    free_shuffles(spark)
    groups = connected_components(links.union(more)).select(F.col("id").alias("sig"), "component")
    some = sized.filter("n > 0").join(groups, "sig", "left").select("doc_id", "mark", "n", F.coalesce("component", "sig").alias("group"))
    rows = materialise(some.union(sized.filter("n = 0").select("doc_id", "mark", "n", F.lit(None).cast("long"))), "jaccard-rows")
    for table in [joined, near, asked, sets, links, parts, known, more, sized]:
        discard(table)
    return rows


def jaccard_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id linked through pairs at num/den or over)."""
    rows = jaccard_groups(docs.filter(F.col(id_col).isNotNull()), words, num, den, id_col, text_col)
    first = rows.filter("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("first"))
    some = rows.filter("group IS NOT NULL").join(first, "group").select("doc_id", F.col("n").alias("n_shingles"), F.col("first").alias("component_id"))
    none = rows.filter("group IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    texts = docs.filter(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("mark"), F.col(text_col).alias("text"))
    unnamed = texts.mapInArrow(_sizes_pass(words), "doc_id long, mark long, n long, sig long").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.union(none).union(unnamed)
