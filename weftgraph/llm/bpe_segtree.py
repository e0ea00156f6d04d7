"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

A word's symbols are the leaves; a leaf holds rank * leaves + position of the pair that starts there, or NONE. An inner
node holds the least of its children, so the root names the leftmost pair of lowest rank. Merging changes three leaves
(the pair, the symbol that goes, the pair before), each with one walk to the root, until the root is NONE: n log n for a
word of n bytes, however long. Words of one size class are merged side by side in arrays; single long ones by a loop.

Texts are cut into words by the byte-level pattern after the file's special strings are taken out whole, so every text is
encoded whole. The pattern never joins across a space between two other characters, so texts are first split at spaces and
each distinct segment of a batch is cut and merged once; a text with a space before other white space is cut as one. A
bounded cache keeps segments between batches and is emptied when full, which changes no result.

Defined results: a null or empty text has no ids, and decodes to the empty text. Rows are independent, so repeated rows,
null ids and any further columns don't matter; `encode` replaces columns named like its results; an empty table gives an
empty result. Ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import arrow_columns

#: A leaf without a pair that merges. Arrays hold 32-bit values, lists any.
NONE = np.iinfo(np.int32).max
#: Fixed value: the public byte-level pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 300_000
#: Segments of more characters aren't kept between batches.
LONG = 40
#: Neither letters, digits nor spaces, nor the sign of contractions.
MARKS = ".,!?;:#*$%&|"
_SPACES = re.compile(r" (?:\s|\Z)")
#: Texts whose distinct words are merged together, by characters.
CHUNK_CHARS = 4_000_000
#: Leaves that are merged side by side.
LEAVES_AT_ONCE = 1 << 17
#: Words with more leaves than this are merged one by one; rank * leaves stays below NONE up to it.
WIDEST = 1 << 12


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def load(path: str) -> dict:
    """The tables of a tokenizer file: bounded by its vocabulary, so they can be broadcast."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    vocab, symbols = data["model"]["vocab"], byte_symbols()
    back = {s: b for b, s in enumerate(symbols)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
    added = {t["content"]: t["id"] for t in data["added_tokens"]}
    pieces = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
    pieces |= {i: s.encode() for s, i in added.items()}
    return {"left": left, "right": right, "into": np.array([vocab[a + b] for a, b in pairs], dtype=np.int64), "bytes": np.array([vocab[s] for s in symbols], dtype=np.int64), "pieces": pieces, "added": added}


class Codec:
    def __init__(self, tables: dict):
        import regex

        self.base = int(max(tables[k].max(initial=0) for k in ("left", "right", "into", "bytes"))) + 2  # the last is no symbol's
        self.ranked: dict[int, int] = {}
        for rank, k in enumerate((tables["left"] * self.base + tables["right"]).tolist()):
            self.ranked.setdefault(k, rank)
        self._hash_ranks()
        self.into, self.byte_ids, self.pieces, self.added = tables["into"], tables["bytes"], tables["pieces"], tables["added"]
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.names = [str(i) for i in range(max(self.base, *self.added.values(), *self.pieces) + 1)]
        self.packed: dict = {}  # segment -> its ids as 32-bit integers
        self.named: dict = {}  # segment -> (its ids as text, the bytes they decode to)
        self.long: list = []

    # --- the tree

    def _hash_ranks(self) -> None:
        """Open addressing in arrays: slots[h], then the next ones, as far as any key was moved."""
        bits = max(4, (len(self.ranked) * 4).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.slots, self.slot_ranks, self.moved = np.full(size + 64, -1, dtype=np.int64), np.full(size + 64, NONE, dtype=np.int32), 0
        keys = np.fromiter(self.ranked, dtype=np.int64, count=len(self.ranked))
        for k, h in zip(keys.tolist(), self._slot(keys).tolist()):
            at = h
            while self.slots[at] >= 0:
                at += 1
            self.slots[at], self.slot_ranks[at], self.moved = k, self.ranked[k], max(self.moved, at - h)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b), NONE where they don't merge."""
        k = a * np.int64(self.base) + b
        h = self._slot(k)
        there = self.slots.take(h)
        rank = np.where(there == k, self.slot_ranks.take(h), np.int32(NONE))
        seek = np.flatnonzero((there != k) & (there >= 0))
        for step in range(1, self.moved + 1):
            if not len(seek):
                break
            there = self.slots.take(h[seek] + step)
            hit = there == k[seek]
            rank[seek[hit]] = self.slot_ranks.take(h[seek[hit]] + step)
            seek = seek[~hit & (there >= 0)]
        return rank

    def merge_side_by_side(self, words: list[bytes], leaves: int) -> list[list[int]]:
        """Ids of words of less than `leaves` (a power of two) bytes. A row has a symbol that never merges at place 0, the
        word's bytes from 1 on, and such a symbol again at place `leaves`."""
        n, cols, none = len(words), leaves + 1, self.base - 1
        length = np.array([len(w) for w in words])
        place = np.arange(cols)
        inside = (place >= 1) & (place <= length[:, None])
        ids = np.full((n, cols), none, dtype=np.int64)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.where(inside & (place < length[:, None]), place + 1, leaves).ravel()
        before = np.tile(place - 1, n)
        tree = np.full((n, 2 * leaves), NONE, dtype=np.int32)
        first = ids[:, :leaves]
        rank = self._rank(first.ravel(), ids[:, 1:].ravel()).reshape(n, leaves)
        tree[:, leaves:] = np.where(rank == NONE, np.int32(NONE), np.where(rank == NONE, 0, rank) * np.int32(leaves) + np.arange(leaves, dtype=np.int32))
        width = leaves
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2
        ids, flat = ids.ravel(), tree.ravel()
        gone = np.zeros(n * cols, dtype=bool)
        levels = leaves.bit_length() - 1
        row = np.arange(n)
        while True:
            root = flat.take(row * (2 * leaves) + 1)
            row, root = row[go := root != NONE], root[go]
            if not len(row):
                break
            off = row * cols
            rank, i = root >> levels, (root & (leaves - 1)).astype(np.int64)
            j = after.take(off + i)
            k = after.take(off + j)
            p = before.take(off + i)
            new = self.into.take(rank)
            ids[off + i] = new
            gone[off + j] = True
            after[off + i] = k
            before[off + k] = i
            pair = self._rank(np.concatenate([new, ids.take(off + p)]), np.concatenate([ids.take(off + k), new]))
            at = np.concatenate([i, p, j])
            leaf = np.full(len(at), NONE, dtype=np.int32)
            leaf[: len(pair)] = np.where(pair == NONE, pair, np.where(pair == NONE, 0, pair) * np.int32(leaves) + at[: len(pair)].astype(np.int32))
            base = np.tile(row * (2 * leaves), 3)
            at += leaves
            flat[base + at] = leaf
            for _ in range(levels):  # the three walks to the root, side by side
                at >>= 1
                child = base + 2 * at
                flat[base + at] = np.minimum(flat.take(child), flat.take(child + 1))
        kept = inside & ~gone.reshape(n, cols)
        found, ends = ids.reshape(n, cols)[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [found[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def merge_one(self, word: bytes) -> list[int]:
        """Ids of one word, by the same tree in plain lists."""
        n, none = len(word), int(NONE)
        leaves = 1 << max(0, (n - 1).bit_length())
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        rank_of, base, into = self.ranked.get, self.base, self.into
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            r = rank_of(ids[i] * base + ids[i + 1])
            if r is not None:
                tree[leaves + i] = r * leaves + i
        for at in range(leaves - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def put(i: int, value: int) -> None:
            at = leaves + i
            tree[at] = value
            while at > 1:
                at >>= 1
                least = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == least:
                    break
                tree[at] = least

        while n > 1 and tree[1] != none:
            rank, i = divmod(tree[1], leaves)
            j = after[i]
            k = after[j]
            ids[i], ids[j] = int(into[rank]), -1
            after[i] = k
            if k < n:
                before[k] = i
            put(j, none)
            r = rank_of(ids[i] * base + ids[k]) if k < n else None
            put(i, none if r is None else r * leaves + i)
            if (p := before[i]) >= 0:
                r = rank_of(ids[p] * base + ids[i])
                put(p, none if r is None else r * leaves + p)
        return [x for x in ids if x >= 0]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        classes: dict[int, list[int]] = {}
        for at, w in enumerate(words):
            if len(w) < 2:
                out[at] = self.byte_ids[list(w)].tolist()
            else:
                classes.setdefault(1 << len(w).bit_length(), []).append(at)
        for leaves, places in classes.items():
            step = max(1, LEAVES_AT_ONCE // leaves)
            for a in range(0, len(places), step):
                part = places[a : a + step]
                many = len(part) >= 24 and leaves <= WIDEST
                found = self.merge_side_by_side([words[x] for x in part], leaves) if many else [self.merge_one(words[x]) for x in part]
                for x, ids in zip(part, found):
                    out[x] = ids
        return out

    # --- texts

    def cut(self, text: str) -> list[str]:
        """Words and special strings of a text, in order."""
        if not self.special or not self.special.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.words.findall(text[at:])

    def segments(self, text: str) -> list:
        """Parts that are cut and merged on their own: (start,) and then strings that follow a space. Texts with special
        strings, or with a space before white space, are one part."""
        if self.special and self.special.search(text) or _SPACES.search(text):
            return [(text,)]
        parts = text.split(" ")
        parts[0] = (parts[0],)
        return parts

    def cut_segment(self, s) -> list[str]:
        """cut() of a segment; letters, with marks after them or not, need no pattern."""
        if not isinstance(s, str):
            return self.cut(s[0])
        if s.isalpha():
            return [" " + s]
        letters = s.rstrip(MARKS)
        return [" " + letters, s[len(letters) :]] if letters.isalpha() else self.words.findall(" " + s)

    def look_up(self, texts: list[list], cache: dict, made) -> dict:
        """The cache, with made(ids) of each segment of texts."""
        if len(cache) > CACHE_WORDS:
            cache.clear()
        missing = list(set().union(*texts).difference(cache))
        cut = [self.cut_segment(s) for s in missing]
        words = list(set().union(*cut))
        ids_of = dict(zip(words, self.merge([w.encode() for w in words])))
        # a word as the pattern cuts it is never a special string: those hold both letters and signs
        ids_of |= {w: [i] for w, i in self.added.items() if w in ids_of}
        for s, ws in zip(missing, cut):
            cache[s] = made(ids_of[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids_of[w]])
        self.long = [s for s in missing if len(s if isinstance(s, str) else s[0]) > LONG]
        return cache

    def forget(self, cache: dict) -> None:
        """Takes long segments out of the cache."""
        for s in self.long:
            del cache[s]

    def piece_bytes(self, ids) -> bytes:
        get = self.pieces.get
        return b"".join([get(i, b"") for i in ids])

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers side by side, so that no list of ids is ever made."""
        cut = [self.segments(t or "") for t in texts]
        known = self.look_up(cut, self.packed, lambda ids: array("i", ids).tobytes())
        out = [b"".join([known[w] for w in ws]) for ws in cut]
        self.forget(self.packed)
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(x, dtype=np.int32).tolist() for x in self.encode_packed(texts)]

    def decode(self, ids) -> str:
        return self.piece_bytes(ids).decode("utf-8", errors="replace")

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text) of each text."""
        cut, names = [self.segments(t or "") for t in texts], self.names
        known = self.look_up(cut, self.named, lambda ids: (",".join([names[i] for i in ids]), self.piece_bytes(ids)))
        out = []
        for ws in cut:
            found = [known[w] for w in ws]
            ids = ",".join([x[0] for x in found if x[0]])
            whole = b"".join([x[1] for x in found]).decode("utf-8", errors="replace").encode()
            out.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(whole).hexdigest()))
        self.forget(self.named)
        return out


@contextmanager
def _uncollected():
    """Without garbage collection, whose rounds would walk the many lists of a batch; they hold no cycles. It goes on after
    the batch, so that later stages in the same worker have it."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_codecs: dict[str, Codec] = {}


def _codec(key: str, tables) -> Codec:
    """One codec in each worker process, kept between tasks."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tables.value)
    return _codecs[key]


def chunks(texts: list[str | None]):
    """Slices of texts of about CHUNK_CHARS characters."""
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _mapped(df: DataFrame, path: str, column: str, made: list, work, without: tuple = ()) -> DataFrame:
    """df, less the columns of `without`, with further columns that work(codec, values) returns as Arrow arrays."""
    spark = df.sparkSession
    key = f"{spark.sparkContext.applicationId}:{path}"
    tables = spark.sparkContext.broadcast(load(path))

    def start():
        codec = _codec(key, tables)

        def each(values):
            import pyarrow as pa

            with _uncollected():
                parts = [work(codec, part[a:b]) for part in [values.to_pylist()] for a, b in chunks(part)]
            return [pa.concat_arrays(c) for c in zip(*parts)]

        return each

    return arrow_columns(df, column, made, start, 1024, without)


def encode(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """df with n_tokens (long) and ids (array of int)."""
    import pyarrow as pa

    def work(codec: Codec, texts):
        ids = codec.encode_packed(texts)
        n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return [pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))]

    return _mapped(df, path, column, [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType()))], work)


def decode(df: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """df with `decoded`, the text of its ids."""
    import pyarrow as pa

    return _mapped(df, path, column, [("decoded", T.StringType())], lambda codec, rows: [pa.array([codec.decode(x or []) for x in rows], pa.string())])


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import pyarrow as pa

    def work(codec: Codec, texts):
        n, ids, text = zip(*codec.digests(texts))
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())]

    return _mapped(df.select("doc_id", "text"), path, "text", [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], work, ("text",))
