"""Byte-level BPE encoding and decoding with contiguous rank arrays."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .support import released, small_batches, text_of

NEVER = np.iinfo(np.int32).max   # rank of a pair that does not merge
WIDTHS = (8, 16, 32, 96)   # widths, in bytes, of the arrays of short words; longer words use a heap
ROWS = 2048                # words scanned together, so that their arrays stay in the CPU's cache
BATCH_CHARS = 1_000_000    # texts encoded at once
CACHE_WORDS = 400_000    # words remembered in a task; the memory is started anew beyond it
# The code points with the White_Space property.
BLANK = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others take the code points from
    256 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def rare_numbers() -> frozenset[str]:
    """Numbers that are not decimal digits; ``re`` counts them as letters."""
    return frozenset(
        c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl")
    )


def word_pattern(rare: str) -> re.Pattern[str]:
    letter, number, blank = rf"[^\W\d_{rare}]", rf"[\d{rare}]", rf"[{BLANK}]"
    other = rf"(?:_|(?!{number})[^\w{BLANK}])"
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|{blank}+(?![^{BLANK}])|{blank}+"
    )


class BytePairs:
    """A byte-level BPE vocabulary read from a tokenizer file.

    A word is held as its part ids and, beside them, the rank of each adjacent
    pair. The smallest rank is found by a scan; its boundary is deleted from
    both arrays and the two neighbouring ranks are looked up again. Words of
    about one length are scanned together, a row each. A scan is quadratic, so
    words of over 96 bytes keep their pairs in a heap over linked parts
    instead; both give the same ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] * self.size + vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.first = [vocab[c] for c in alphabet]
        self.first_ids = np.array(self.first, np.int32)
        self.merged_ids = np.array(self.merged, np.int32)
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = keys.argsort()
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(self.ranks.values(), np.int32, len(keys))[order], NEVER)
        back = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.rare = rare_numbers()
        self.word = word_pattern("")
        self.word_rare = word_pattern("".join(map(re.escape, sorted(self.rare))))
        self.uneven = re.compile(rf" [{BLANK}]|[{BLANK}] ")
        self.known: dict[str, bytes] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def scan(self, words: list[bytes], width: int) -> list[bytes]:
        """Packed ids of short words of 1 to ``width`` bytes, all words at once.

        Row by row, ``parts`` and ``ranks`` are the contiguous arrays of a word.
        """
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        parts = np.full((n, width + 1), -1, np.int32)
        parts[:, :width][np.arange(width) < size[:, None]] = self.first_ids[flat]
        ranks = np.full((n, width), NEVER, np.int32)
        inner = parts[:, 1:] >= 0
        ranks[inner] = self.rank_of(parts[:, :-1][inner], parts[:, 1:][inner])
        done, columns, row_ids = parts.copy(), np.arange(width), np.arange(n)
        while len(row_ids):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(at)), at]
            open_ = least < NEVER
            if not open_.all():
                done[row_ids[~open_]] = parts[~open_]
                parts, ranks, row_ids, at, least = parts[open_], ranks[open_], row_ids[open_], at[open_], least[open_]
                if not len(row_ids):
                    break
            rows = np.arange(len(at))
            parts[rows, at] = self.merged_ids[least]
            behind = columns > at[:, None]
            np.copyto(parts[:, :-1], parts[:, 1:].copy(), where=behind)
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=columns[:-1] >= at[:, None])
            ranks[:, -1] = NEVER
            here, right = parts[rows, at], parts[rows, at + 1]
            ranks[rows, at] = np.where(right >= 0, self.rank_of(here, right), NEVER)
            inner = at > 0
            ranks[rows[inner], at[inner] - 1] = self.rank_of(parts[rows[inner], at[inner] - 1], here[inner])
        kept = done >= 0
        ends = (4 * kept.sum(axis=1).cumsum()).tolist()
        packed = done[kept].astype("<u4").tobytes()
        return [packed[s:e] for s, e in zip([0, *ends], ends)]

    def heap(self, parts: list[int]) -> list[int]:
        """Ids of a long word: pairs in a heap by rank, then position."""
        n, size, rank_of, merged = len(parts), self.size, self.ranks.get, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [(r, i) for i in range(n - 1) if (r := rank_of(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(pairs)
        while pairs:
            rank, i = heapq.heappop(pairs)
            j = after[i]
            if parts[i] < 0 or j >= n or rank_of(parts[i] * size + parts[j]) != rank:
                continue
            parts[i], parts[j] = merged[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(parts[i] * size + parts[k])) is not None:
                    heapq.heappush(pairs, (r, i))
            if (h := before[i]) >= 0 and (r := rank_of(parts[h] * size + parts[i])) is not None:
                heapq.heappush(pairs, (r, h))
        return [p for p in parts if p >= 0]

    def merge(self, words: list[str]) -> list[bytes]:
        """Packed ids of words, in their order."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list[bytes] = [b""] * len(raw)
        low = 0
        for width in WIDTHS:
            chosen = [i for i, w in enumerate(raw) if low < len(w) <= width]
            for start in range(0, len(chosen), ROWS):
                some = chosen[start : start + ROWS]
                for i, ids in zip(some, self.scan([raw[i] for i in some], width)):
                    out[i] = ids
            low = width
        for i, w in enumerate(raw):
            if len(w) > low:
                out[i] = array("I", self.heap([self.first[b] for b in w])).tobytes()
        return out

    def words(self, text: str) -> list[str]:
        pattern = self.word if self.rare.isdisjoint(text) else self.word_rare
        return pattern.findall(text)

    def cuts(self, text: str) -> list[str]:
        """Pieces of a text without special tokens that encode on their own.

        A single space between two other characters always starts a word, so
        the text is cut there. Texts with other uses of the space are cut by
        the pattern.
        """
        if self.uneven.search(text) or text[:1] == " " or text[-1:] == " " or "\0" in text:
            return self.words(text)
        return text.replace(" ", "\0 ").split("\0")

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces that this worker has not met before."""
        alone = [p for p in pieces if p[1:].isalpha() and (p[0] == " " or p[0].isalpha())]
        self.known.update(zip(alone, self.merge(alone)))
        mixed = [(p, self.words(p)) for p in pieces.difference(alone)]
        ids = iter(self.merge([w for _, words in mixed for w in words]))
        for p, words in mixed:
            self.known[p] = b"".join([next(ids) for _ in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts; special tokens inside them count as themselves."""
        special = self.special
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        cut = [
            [c for p in self.cut.split(t) for c in ([p] if p in special else self.cuts(p) if p else [])]
            if any(s in t for s in special) else self.cuts(t)
            for t in texts
        ]
        met = set().union(*cut)
        met.discard("")
        self.learn(met.difference(self.known, special))
        # A small table of this batch's pieces is quicker to read than all.
        near = {p: self.known[p] for p in met.difference(special)}
        near |= {s: i.to_bytes(4, "little") for s, i in special.items()}
        near[""] = b""
        return [b"".join(map(near.__getitem__, pieces)) for pieces in cut]

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> BytePairs:
    """A worker reads a vocabulary once."""
    return BytePairs(path)


def in_parts(column: pa.Array) -> Iterator[list[str]]:
    """A column's texts in lists of a bounded size."""
    texts, size = [], 0
    for text in column:
        texts.append(text.as_py())
        size += len(texts[-1])
        if size > BATCH_CHARS:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def encode_texts(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", *, keep_ids: bool = False,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Ids of every whole text, and the text decoded from them.

    Returns (id, n_tokens, ids_sha256, decoded_sha256) and, with ``keep_ids``,
    ids (binary, little-endian unsigned 32-bit) and decoded, then the whole
    numbers of ``carry``, as they are. The file at
    ``vocabulary_path`` must exist on every executor, as installed packages do.
    Null and empty texts have no tokens. Rows are independent: nothing is
    shuffled, repeated rows and ids repeat, an empty table gives an empty
    result, and other columns, whatever their names, are not read.
    """
    fields = [
        T.StructField(id_col, T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if keep_ids:
        fields += [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]

    carry = carry or {}
    fields += [T.StructField(name, T.LongType()) for name in carry]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = vocabulary(vocabulary_path)
        for batch in released(batches):
            packed, counts, digests, told, decoded = [], [], [], [], []
            for texts in in_parts(batch.column(1)):
                for ids in pairs.encode(texts):
                    again = pairs.decode(ids)
                    counts.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    told.append(hashlib.sha256(again.encode()).hexdigest())
                    if keep_ids:
                        packed.append(ids)
                        decoded.append(again)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(told, pa.string())]
            if keep_ids:
                columns += [pa.array(packed, pa.binary()), pa.array(decoded, pa.string())]
            columns += batch.columns[2:]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        pairs.known.clear()      # the worker stays; its memory of words need not

    rows = small_batches(docs).select(docs[id_col].cast("long").alias(id_col), text_of(text_col).alias("text"), *(c.cast("long").alias(n) for n, c in carry.items()))
    return rows.mapInArrow(encode, T.StructType(fields))
