"""Byte-level BPE encoding and decoding.

Every pre-token is merged with a segment tree over the ranks of its adjacent
pairs: a leaf holds ``rank * width + position`` of the pair that starts there,
an inner node the smaller of its two children, so the root names the leftmost
pair of lowest rank. A merge changes three leaves and their paths to the root.
Short pre-tokens are merged side by side, one tree per row of a numpy matrix;
long ones use the same tree on Python lists.

Vocabulary and merges come from a public tokenizer file and are sent to the
executors as one broadcast, whose size is that of the file. Documents are never
split over tasks and no row leaves its partition: there is no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.llm.common import id_text, text_blocks

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Where cutting before each space could cut a run of white space.
UNSAFE = r"\p{White_Space} (?:\p{White_Space}|\Z)"
NO_PAIR = np.int64(1) << 40
SHORT = 64                      # bytes; longer pre-tokens use the list tree
BLOCK_CHARS = 500_000           # text encoded at once; longer documents whole, one at a time


@dataclass
class Vocabulary:
    """Merge table sorted by pair key, byte symbols, and the bytes of every id."""

    size: int
    byte_id: np.ndarray         # 256 -> id
    pair_key: np.ndarray        # sorted left * size + right
    pair_rank: np.ndarray
    merged: np.ndarray          # by rank -> id
    data: np.ndarray            # bytes of all ids, one after the other
    starts: np.ndarray          # id -> first byte; one more at the end
    special: dict[str, int]


    def plain(self) -> tuple:
        """The fields as numbers and arrays, which a worker can read without this package."""
        return (self.size, self.byte_id, self.pair_key, self.pair_rank, self.merged, self.data,
                self.starts, self.special)


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte, as byte-level vocabularies spell them:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file in the JSON form of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids, symbols = spec["model"]["vocab"], byte_symbols()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*ids.values(), *special.values()]) + 1
    spelled = [b""] * size
    for token, i in ids.items():
        spelled[i] = bytes(symbols[c] for c in token)
    for token, i in special.items():
        spelled[i] = token.encode()
    byte_id = np.zeros(256, np.int64)
    for c, b in symbols.items():
        byte_id[b] = ids[c]
    pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in spec["model"]["merges"]]
    key = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
    order = np.argsort(key, kind="stable")
    starts = np.zeros(size + 1, np.int64)
    np.cumsum([len(b) for b in spelled], out=starts[1:])
    return Vocabulary(size, byte_id, key[order], order.astype(np.int64),
                      np.array([ids[a + b] for a, b in pairs], np.int64),
                      np.frombuffer(b"".join(spelled), np.uint8), starts, special)


def pair_ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each pair; NO_PAIR where the pair never merges (right < 0: none)."""
    key = left * v.size + right
    at = np.minimum(np.searchsorted(v.pair_key, key), len(v.pair_key) - 1)
    return np.where((v.pair_key[at] == key) & (right >= 0), v.pair_rank[at], NO_PAIR)


def merge_rows(v: Vocabulary, tokens: np.ndarray, width: int) -> np.ndarray:
    """Merge many short pre-tokens at once.

    ``tokens``: rows of byte ids, padded with -1 to ``width`` (a power of two).
    Returns the rows with merged-away places set to -1."""
    n = len(tokens)
    token = np.full((n, width + 1), -1, np.int64)
    token[:, :width] = tokens
    after = np.tile(np.arange(1, width + 2), (n, 1))      # next living place
    before = np.tile(np.arange(-1, width), (n, 1))
    tree = np.empty((n, 2 * width), np.int64)
    place = np.arange(width)
    rank = pair_ranks(v, token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width)
    tree[:, width:] = rank * width + place
    for lo in [width >> k for k in range(1, width.bit_length())]:
        tree[:, lo:2 * lo] = np.minimum(tree[:, 2 * lo:4 * lo:2], tree[:, 2 * lo + 1:4 * lo:2])

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + width
        tree[rows, node] = value * width + at
        node = node >> 1
        for _ in range(width.bit_length() - 1):
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    rows = np.flatnonzero(tree[:, 1] < NO_PAIR * width)
    while len(rows):
        best = tree[rows, 1]
        at, new = best % width, v.merged[best // width]
        gone = after[rows, at]
        nxt = after[rows, gone]
        token[rows, at] = new
        token[rows, gone] = -1
        after[rows, at] = nxt
        before[rows, np.minimum(nxt, width)] = at
        put(rows, gone, np.full(len(rows), NO_PAIR))
        right = np.where(nxt < width, token[rows, np.minimum(nxt, width)], -1)
        put(rows, at, pair_ranks(v, new, right))
        prev = before[rows, at]
        has = prev >= 0
        if has.any():
            put(rows[has], prev[has], pair_ranks(v, token[rows[has], prev[has]], new[has]))
        rows = rows[tree[rows, 1] < NO_PAIR * width]
    return token[:, :width]


def merge_long(v: Vocabulary, tokens: list[int]) -> list[int]:
    """Merge one pre-token of any length with the same tree on lists."""
    n = len(tokens)
    width = 1 << max(1, (n - 1).bit_length())
    no_pair = int(NO_PAIR) * width
    lookup = _pair_table(v)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def leaf(at: int) -> int:
        nxt = after[at]
        rank = lookup.get((tokens[at], tokens[nxt])) if nxt < n else None
        return no_pair if rank is None else rank * width + at

    tree = [no_pair] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = leaf(i)
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(at: int, value: int) -> None:
        node = at + width
        tree[node] = value
        while node > 1:
            node >>= 1
            small = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == small:
                return
            tree[node] = small

    while tree[1] < no_pair:
        at, rank = tree[1] % width, tree[1] // width
        gone = after[at]
        tokens[at], tokens[gone] = int(v.merged[rank]), -1
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        put(gone, no_pair)
        put(at, leaf(at))
        if before[at] >= 0:
            put(before[at], leaf(before[at]))
    return [t for t in tokens if t >= 0]


def _pair_table(v: Vocabulary) -> dict[tuple[int, int], int]:
    table = getattr(v, "_table", None)
    if table is None:
        left, right = np.divmod(v.pair_key, v.size)
        table = dict(zip(zip(left.tolist(), right.tolist(), strict=True),
                         v.pair_rank.tolist(), strict=True))
        v._table = table
    return table


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def merge_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all distinct pre-tokens: (flat ids, offsets)."""
    size = np.array([len(w) for w in words], np.int64)
    flat = v.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    starts = np.cumsum(size) - size
    count = np.zeros(len(words), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    lo, width = 0, 4
    while lo < SHORT:
        of_width = np.flatnonzero((size > lo) & (size <= width))
        for pick in np.array_split(of_width, max(1, len(of_width) * width // 500_000 + 1)):
            if len(pick):
                grid = np.full((len(pick), width), -1, np.int64)
                inside = np.arange(width) < size[pick, None]
                grid[inside] = flat[ragged(starts[pick], size[pick])]
                grid = merge_rows(v, grid, width)
                count[pick] = (grid >= 0).sum(1)
                parts.append((pick, grid[grid >= 0]))
        lo, width = width, 2 * width
    for i in np.flatnonzero(size > SHORT).tolist():
        ids = merge_long(v, flat[starts[i]:starts[i] + size[i]].tolist())
        count[i] = len(ids)
        parts.append((np.array([i]), np.array(ids, np.int64)))
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(count, out=offsets[1:])
    out = np.zeros(offsets[-1], np.int64)
    for pick, ids in parts:
        out[ragged(offsets[pick], count[pick])] = ids
    return out, offsets


class _Codes(dict):
    """Number of each key in order of first sight."""

    def __missing__(self, key):
        self[key] = code = len(self)
        return code


class Encoder:
    """Encodes blocks of texts; remembers the ids of the chunks it has seen.

    A text is cut before its spaces into chunks, so that pre-tokens are found
    and merged once per distinct chunk. Where a cut could part a run of white
    space, the text is one chunk. About ``keep`` characters of chunks are
    remembered: the memory is emptied when it is full, which changes no id."""

    def __init__(self, v: Vocabulary, keep: int = 1_000_000):
        import regex

        self.v, self.keep = v, keep
        self.split, self.unsafe = regex.compile(PATTERN), regex.compile(UNSAFE)
        names = sorted(v.special, key=len, reverse=True)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.clear()

    def clear(self) -> None:
        self.chunks, self.chars = _Codes(), 0
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def codes(self, text: str) -> list[int]:
        """Chunk numbers of one text; those of special tokens are tuples' numbers."""
        chunk = self.chunks.__getitem__
        if self.apart and self.apart.search(text):
            pieces = self.apart.split(text)
        else:
            pieces = [text]
        own: list[int] = []
        for i, piece in enumerate(pieces):
            if i % 2:
                own.append(chunk((piece,)))
            elif piece and self.unsafe.search(piece):
                own.append(chunk(piece))
            elif piece:
                if piece[0] != " ":                       # the rest of a chunk follows its space
                    first, _, piece = piece.partition(" ")
                    own.append(chunk((None, first)))
                    if not _:
                        continue
                else:
                    piece = piece[1:]
                own.extend(map(chunk, piece.split(" ")))
        return own

    def learn(self) -> None:
        """Ids of the chunks first seen in this block."""
        known = len(self.starts)
        words = _Codes()
        word, find = words.__getitem__, self.split.findall
        inner: list[int] = []
        per_chunk: list[int] = []
        put, count = inner.append, per_chunk.append
        for chunk in islice(self.chunks, known, None):
            self.chars += len(chunk)
            if type(chunk) is tuple:
                found = find(chunk[1]) if len(chunk) == 2 else [chunk]
            elif chunk.isalpha():                         # letters only: one pre-token
                put(word(" " + chunk))
                count(1)
                continue
            elif (core := chunk[:-1]).isalpha() and chunk[-1] in ".,!|":
                put(word(" " + core))                     # letters and one mark: two
                put(word(chunk[-1]))
                count(2)
                continue
            elif " " in chunk:                            # a whole piece, kept for its white space
                found = find(chunk)
            else:
                found = find(" " + chunk)
            inner.extend(map(word, found))
            count(len(found))
        lone = [(c, self.v.special[w[0]]) for w, c in words.items() if type(w) is tuple]
        ids, offsets = merge_words(self.v, [w.encode() if type(w) is str else b"" for w in words])
        starts, size = offsets[:-1].copy(), np.diff(offsets)
        for c, i in lone:
            starts[c], size[c] = len(ids), 1
            ids = np.append(ids, i)
        of = np.array(inner, np.int64)
        many = np.array(per_chunk, np.int64)
        flat = ids[ragged(starts[of], size[of])]
        ends = np.concatenate([[0], np.cumsum(size[of])])
        cuts = ends[np.concatenate([[0], np.cumsum(many)])]
        self.starts = np.concatenate([self.starts, len(self.ids) + cuts[:-1]])
        self.sizes = np.concatenate([self.sizes, np.diff(cuts)])
        self.ids = np.concatenate([self.ids, flat.astype(np.uint32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, as (flat uint32 ids, offsets by text)."""
        if self.chars > self.keep:
            self.clear()
        own = [self.codes(t) for t in texts]
        self.learn()
        of = np.concatenate([*(np.array(x, np.int64) for x in own), np.zeros(0, np.int64)])
        size = self.sizes[of]
        ends = np.concatenate([[0], np.cumsum(size)])
        bounds = ends[np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)]
        return self.ids[ragged(self.starts[of], size)].astype("<u4"), bounds


def encode_texts(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return Encoder(v).encode(texts)


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """Text of ids; bytes that are no UTF-8 become the replacement character."""
    ids = ids.astype(np.int64)
    first = v.starts[ids]
    return v.data[ragged(first, v.starts[ids + 1] - first)].tobytes().decode("utf-8", "replace")


def shared_vocabulary(spark: SparkSession, vocab_path: str):
    """The vocabulary as a broadcast of plain arrays."""
    return spark.sparkContext.broadcast(load_vocabulary(vocab_path).plain())


def encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id",
           text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens long, ids binary (little-endian unsigned 32-bit); with
    ``decoded`` also the text decoded from these ids, in the same task.

    A null or empty text gives no ids. Repeated rows come out repeated; columns
    besides the two named are not read; an empty table gives no rows."""
    shared = shared_vocabulary(df.sparkSession, vocab_path)
    names = ["doc_id", "n_tokens", "ids"] + (["decoded"] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*shared.value)
        encoder = Encoder(v)
        for doc_ids, texts in text_blocks(batches, BLOCK_CHARS):
            ids, bounds = encoder.encode(texts)
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [pa.array(doc_ids, pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                       pa.array([p.tobytes() for p in parts], pa.binary())]
            if decoded:
                columns.append(pa.array([decode_ids(v, p) for p in parts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return id_text(df, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """The rows of :func:`encode` with ``decoded``, the text of their ids."""
    shared = shared_vocabulary(encoded.sparkSession, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [decode_ids(v, np.frombuffer(x.as_py() or b"", "<u4"))
                         for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the text decoded from them."""
    return encode(docs, vocab_path, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def default_vocabulary(spark: SparkSession | None = None) -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
