"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves; leaf i holds ``rank(pair(i, next(i))) * width + i`` (or infinity),
every inner node the minimum of its children.  The root therefore names the lowest rank and,
among equal ranks, the leftmost position.  A merge changes at most three leaves, each a
logarithmic point update, until the root is infinite: O(n log n) for a word of n symbols,
which keeps very long unbroken words cheap.

Edge cases: a null or empty text has no ids and decodes to ''.  Strings of special tokens in a
raw text become their special ids; other spellings of them (in capitals, say) are ordinary text.  Repeated rows
and ties are encoded alike; extra columns are carried through unless they clash with the output names, in which case
the output wins; an empty table gives no rows.  Texts are taken in slices of bounded bytes, a longer one alone; caches
are bounded by words and by bytes.
"""

from __future__ import annotations

import ctypes
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.text_arrays import steps
from quern.plans.shared import ship_package

#: Words kept by each Python worker; two generations of this size, so memory is bounded.
CACHE_WORDS = 200_000
CACHE_BYTES = 48 << 20
#: Rows and bytes of text that are encoded together (one row at least).
SLICE_ROWS, SLICE_BYTES = 256, 2 << 20
#: Symbols from which a word's tree is held as plain machine words.
LONG_WORD = 4096
INFINITE = 1 << 62
#: White space as the vocabulary's patterns understand it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """The printable stand-in for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class SegmentTree:
    """Minimum tree with point updates."""

    def __init__(self, leaves: list[int] | np.ndarray):
        size = 1
        while size < len(leaves):
            size *= 2
        self.size = size
        if isinstance(leaves, np.ndarray):
            flat = np.full(2 * size, INFINITE, np.int64)
            flat[size : size + len(leaves)] = leaves
            half = size // 2
            while half:
                flat[half : 2 * half] = np.minimum(flat[2 * half : 4 * half : 2], flat[2 * half + 1 : 4 * half : 2])
                half //= 2
            self.node = array("q")
            self.node.frombytes(flat.data.cast("B"))
            return
        self.node = node = [INFINITE] * size + leaves + [INFINITE] * (size - len(leaves))
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def put(self, i: int, value: int) -> None:
        node = self.node
        i += self.size
        node[i] = value
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            low = a if a < b else b
            if node[i] == low:
                return
            node[i] = low
            i >>= 1


class _Words(dict):
    """Stretch -> (ids as int32 bytes, decoded text); fills itself, and drops the older generation when full.

    A special token that stands in a raw text is the key (token,); a string is always ordinary text.
    """

    def __init__(self, codec: BpeCodec):
        super().__init__()
        self.codec, self.old, self.bytes = codec, {}, 0

    def __missing__(self, word: str | tuple[str]) -> tuple[bytes, str]:
        found = self.codec.reserved.get(word) or self.old.get(word)
        if found is None:
            ids = [i for w in self.codec.words.findall(word) for i in self.codec.encode_word(w)]
            found = (array("i", ids).tobytes(), self.codec.decode(ids))
        self[word] = found
        return found

    def make_room(self) -> None:
        if len(self) >= CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.old = dict(self) if self.bytes <= CACHE_BYTES else {}
            self.clear()
            self.bytes = 0


class BpeCodec:
    """Encoder and decoder for a vocabulary file in the tokenizers JSON layout (BPE with a word-end suffix)."""

    def __init__(self, layout: dict):
        model = layout["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in layout.get("added_tokens", [])}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if not isinstance(pair, str) else pair.split(" ")
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        split = next(p["pattern"]["Regex"] for p in layout["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"\s", SPACE))
        self.apart = regex.compile(f"[{SPACE}]+")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        alphabet = byte_alphabet()
        self.inner = [self.vocab.get(c) for c in alphabet]
        self.final = [self.vocab.get(c + self.suffix) for c in alphabet]
        if None in self.inner or None in self.final:
            raise ValueError("the vocabulary must hold every byte, with and without the word end")
        self.byte_symbols = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        self.merged: dict[str, tuple[bytes, str]] = {}
        self.merged_bytes = 0
        keys = np.array([(a << 20) | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        ranks = np.array([r for r, _ in self.pairs.values()], np.int64)
        results = np.zeros(len(model["merges"]) + 1, np.int64)
        results[ranks] = [new for _, new in self.pairs.values()]
        self.sorted_pairs = keys[order], ranks[order], results
        self.cache = _Words(self)
        self.reserved = {(t,): (array("i", [i]).tobytes(), t) for t, i in self.special.items()}

    @classmethod
    def from_json(cls, text: str) -> BpeCodec:
        return cls(json.loads(text))

    def merge(self, symbols: list[int]) -> list[int]:
        """Applies merges, lowest rank first and leftmost among equals, until none applies."""
        n = len(symbols)
        pairs = self.pairs
        if n < 2:
            return symbols
        after, before = range(1, n + 1), range(-1, n - 1)
        if n < LONG_WORD:
            leaves = []
            for p in zip(symbols, symbols[1:]):
                found = pairs.get(p)
                leaves.append(found[0] * n + len(leaves) if found else INFINITE)
            after, before = list(after), list(before)
        else:
            flat = np.array(symbols, np.int64)
            keys, ranks, _ = self.sorted_pairs
            key = (flat[:-1] << 20) | flat[1:]
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            leaves = np.where(keys[found] == key, ranks[found] * n + np.arange(n - 1), INFINITE)
            symbols, after, before = array("i", symbols), array("q", after), array("q", before)
        tree = SegmentTree(leaves)
        node, put = tree.node, tree.put
        while (low := node[1]) != INFINITE:
            i = low % n
            j = after[i]
            symbols[i] = new = pairs[symbols[i], symbols[j]][1]
            after[i] = k = after[j]
            symbols[j] = -1
            if j < n - 1:
                put(j, INFINITE)
            if k < n:
                before[k] = i
                found = pairs.get((new, symbols[k]))
                put(i, found[0] * n + i if found else INFINITE)
            else:
                put(i, INFINITE)
            h = before[i]
            if h >= 0:
                found = pairs.get((symbols[h], new))
                put(h, found[0] * n + h if found else INFINITE)
        return [s for s in symbols if s >= 0]

    def symbols(self, word: str) -> list[int]:
        raw = word.encode()
        inner = self.inner
        out = [inner[b] for b in raw[:-1]]
        out.append(self.final[raw[-1]])
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        return self.merge(self.symbols(word))

    def forget(self) -> None:
        """Empties the caches."""
        self.cache.clear()
        self.cache.old, self.cache.bytes = {}, 0
        self.merged.clear()
        self.merged_bytes = 0
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case letter by letter (no final sigma)."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def learn(self, pieces: list[str | tuple[str]]) -> None:
        """Puts stretches that the cache lacks into it, their words merged side by side."""
        cache = self.cache
        cache.make_room()
        lacking = [p for p in {*pieces} if p not in cache and p not in cache.old and p not in self.reserved]
        find = self.words.findall
        apart = [(p,) if p.isalpha() and p.isascii() else find(p) for p in lacking]
        if len(self.merged) > CACHE_WORDS or self.merged_bytes > CACHE_BYTES:
            self.merged.clear()
            self.merged_bytes = 0
        merged = self.merged
        new = list({w for ws in apart for w in ws}.difference(merged))
        made = self.merge_many(new)
        merged.update(zip(new, made))
        self.merged_bytes += sum(map(len, new)) + sum([len(x[0]) + len(x[1]) for x in made])
        for p, ws in zip(lacking, apart):
            if len(ws) == 1:
                cache[p] = merged[ws[0]]
            else:
                parts = [merged[w] for w in ws]
                cache[p] = (b"".join([x[0] for x in parts]), " ".join([x[1] for x in parts]))
        cache.bytes += sum([len(p) + len(cache[p][0]) + len(cache[p][1]) for p in lacking])

    def merge_many(self, words: list[str]) -> list[tuple[bytes, str]]:
        """(ids, decoded text) of each word: one segment tree a row, all rows take their next merge together."""
        out: list[tuple[bytes, str]] = [(b"", "")] * len(words)
        by_size: dict[int, list[int]] = {}
        raws = [w.encode() for w in words]
        for k, raw in enumerate(raws):
            by_size.setdefault(1 << (len(raw) + 1).bit_length() if len(raw) <= 62 else 0, []).append(k)
        token = self.token
        for size, rows in by_size.items():
            if size and len(rows) > 40:
                found = self._merge_rows([raws[k] for k in rows], size)
            else:
                found = [self.encode_word(words[k]) for k in rows]
            for k, ids in zip(rows, found):
                out[k] = (array("i", ids).tobytes(), " ".join([token[i] for i in ids]))
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rank * 64 + position for pairs that merge, INFINITE for the rest (a negative symbol stands for none)."""
        keys, ranks, _ = self.sorted_pairs
        key = (a << 20) | b
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[found] == key) & (a >= 0) & (b >= 0), (ranks[found] << 6) | at, INFINITE)

    def _merge_rows(self, many: list[bytes], size: int) -> list[list[int]]:
        w = len(many)
        lengths = np.fromiter(map(len, many), np.int64, w)
        symbol = np.full((w, size), -1, np.int64)  # positions 1..n; 0 and n+1 stand for the ends
        row = np.repeat(np.arange(w), lengths)
        col = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        ends = np.cumsum(lengths) - 1
        raw = np.frombuffer(b"".join(many), np.uint8)
        flat = self.byte_symbols[0][raw]
        flat[ends] = self.byte_symbols[1][raw[ends]]
        symbol[row, col] = flat
        after = np.tile(np.arange(1, size + 1), (w, 1))
        before = np.tile(np.arange(-1, size - 1), (w, 1))
        tree = np.full((w, 2 * size), INFINITE, np.int64)
        places = np.broadcast_to(np.arange(size - 1), (w, size - 1))
        tree[:, size : 2 * size - 1] = self._ranks(symbol[:, :-1], symbol[:, 1:], places)
        half = size // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        node, sym, nxt, prv = tree.ravel(), symbol.ravel(), after.ravel(), before.ravel()
        results = self.sorted_pairs[2]
        active = np.flatnonzero(tree[:, 1] != INFINITE)
        while len(active):
            root, base = node[active * (2 * size) + 1], active * size
            i = root & 63
            j = nxt[base + i]
            k = nxt[base + j]
            h = prv[base + i]
            new = results[root >> 6]
            sym[base + i] = new
            sym[base + j] = -1
            nxt[base + i] = k
            prv[base + k] = i
            leaf = active * (2 * size) + size
            node[leaf + j] = INFINITE
            node[leaf + i] = self._ranks(new, sym[base + k], i)
            node[leaf + h] = self._ranks(sym[base + h], new, h)
            top = active * (2 * size)
            ups = [h + size, i + size, j + size]
            while ups[0][0] > 1:
                ups = [u >> 1 for u in ups]
                for u in ups:
                    child = top + 2 * u
                    node[top + u] = np.minimum(node[child], node[child + 1])
            active = active[node[top + 1] != INFINITE]
        ends = np.cumsum((symbol >= 0).sum(1)).tolist()
        ids = symbol[symbol >= 0].tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def stretches(self, text: str) -> list[str | tuple[str]]:
        """The normalised stretches between white space, with special tokens of the raw text apart."""
        if self.specials is not None and "<" in text and (parts := list(self.specials.finditer(text))):
            out, at = [], 0
            for m in parts:
                out += [*self.stretches(text[at : m.start()]), (m[0],)]
                at = m.end()
            return out + self.stretches(text[at:])
        text = self.normal(text)
        # str.split also parts at U+001C..U+001F, which the vocabulary's pattern counts as symbols
        return text.split() if text.isprintable() or not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w for w in self.apart.split(text) if w]

    def pieces(self, texts: list[str]) -> list[list[tuple[bytes, str]]]:
        """For each text, (ids as int32 bytes, decoded text) of each stretch."""
        apart = [self.stretches(t) for t in texts]
        self.learn([w for words in apart for w in words])
        get = self.cache.__getitem__
        return [list(map(get, words)) for words in apart]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(p[0] for p in self.pieces([text or ""])[0]), dtype="<i4").tolist()

    def decode(self, ids) -> str:
        """Token strings joined by one space (the file names no decoder); unknown ids are passed over."""
        return " ".join(self.token[i] for i in ids if i in self.token)


_codecs: dict[int, BpeCodec] = {}


def _codec(layout: str) -> BpeCodec:
    key = hash(layout)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = BpeCodec.from_json(layout)
    return _codecs[key]


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = "decoded") -> DataFrame:
    """Every row of docs with its ids and, if decoded_col is given, the text decoded from them.

    ``vocabulary`` is the path of a vocabulary file on the driver; its text (about 2 MB, fixed) goes with the
    tasks.  Narrow: no shuffle, one Arrow batch at a time.
    """
    with open(vocabulary, encoding="utf-8") as f:
        layout = f.read()
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(layout)
    made = {ids_col, decoded_col}
    kept = [c for c in docs.columns if c not in made]
    docs = docs.select(*[docs[c] for c in kept]) if len(kept) < len(docs.columns) else docs
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded_col, T.StringType(), False)] if decoded_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        yield from coded(codec, batches)
        codec.forget()  # the worker may serve other operators next

    def coded(codec: BpeCodec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part.slice(at, SLICE_ROWS) for whole in batches for part in steps(whole, text_col, SLICE_BYTES) for at in range(0, part.num_rows, SLICE_ROWS)):
            if batch.num_rows:
                blobs, texts, ends = [], [], [0]
                for parts in codec.pieces([t or "" for t in batch.column(text_col).to_pylist()]):
                    blob = b"".join([p[0] for p in parts])
                    blobs.append(blob)
                    ends.append(ends[-1] + len(blob) // 4)
                    if decoded_col:
                        texts.append(" ".join([p[1] for p in parts if p[1]]))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), dtype="<i4"), pa.int32()))
                columns = [*batch.columns, ids, *([pa.array(texts, pa.string())] if decoded_col else [])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def bpe_decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Every row of rows with the text decoded from its ids (null: '')."""
    with open(vocabulary, encoding="utf-8") as f:
        layout = f.read()
    ship_package(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(layout)
    kept = [c for c in rows.columns if c != decoded_col]
    rows = rows.select(*[rows[c] for c in kept])
    schema = T.StructType([*rows.schema.fields, T.StructField(decoded_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for batch in batches:
            texts = [codec.decode(i or []) for i in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
