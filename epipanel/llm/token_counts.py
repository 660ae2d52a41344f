"""Token counts from a tokenizer compiled to a finite-state transducer."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import BLANK, byte_alphabet, in_parts
from .support import text_of

SPACE, LETTER, NUMBER, OTHER = range(4)
CHUNK = 256              # bytes of a chunk
MAX_STATES = 250_000     # compiled states a worker holds; it starts anew beyond them
START = 0


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)),
        np.uint8, sys.maxunicode + 1,
    )
    for c in re.findall(f"[{BLANK}]", "".join(map(chr, range(0x3001)))):
        table[ord(c)] = SPACE
    return table


class CountTransducer:
    """Deterministic transducer over the bytes of words; edges carry token counts.

    A sequence of tokens is what byte-pair merging yields exactly if each pair
    of neighbours is what merging yields for that pair alone. So the last token
    of every prefix of a word is unique, and it depends only on the places
    behind it from which a longer token may still start. A state lists these
    places: the node of the token trie that has been reached since, the last
    token there, and the count there less the count here. An edge reads a byte
    and emits the change of the count, of which it has two: one if the word goes
    on, one if it ends there, as its last byte is then another symbol. The
    places lie within one longest token, so there are finitely many states.
    Those that texts reach are compiled when first needed and kept in arrays.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = suffix = model["end_of_word_suffix"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.mid = [vocab[c] for c in alphabet]
        self.last = [vocab[c + suffix] for c in alphabet]
        self.parts: dict[int, tuple[int, ...]] = {}
        # The trie's nodes: children by byte, token that ends here, token that closes a word here.
        self.trie: list[tuple[dict[int, int], list[int]]] = [({}, [-1, -1])]
        for token, i in vocab.items():
            if token in self.special:
                continue
            closes = token.endswith(suffix) and token != suffix
            raw = [back[c] for c in token.removesuffix(suffix if closes else "")]
            node = 0
            for b in raw:
                children = self.trie[node][0]
                if b not in children:
                    children[b] = len(self.trie)
                    self.trie.append(({}, [-1, -1]))
                node = children[b]
            self.parts[i] = tuple(self.mid[b] for b in raw[:-1]) + ((self.last if closes else self.mid)[raw[-1]],)
            self.trie[node][1][closes] = i
        longest = max(map(len, self.parts.values()))
        self.small = np.int8 if longest < 127 else np.int16
        # Columns of the arrays: the bytes met so far.
        self.column = np.full(256, -1, np.int16)
        self.bytes: list[int] = []
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids = {((0, -1, 0),): START}
        self.states = [((0, -1, 0),)]
        self.next = np.full((1024, 128), -1, np.int32)
        self.emits = np.zeros((1024, 128, 2), self.small)

    def columns(self, data: np.ndarray) -> np.ndarray:
        """Columns of bytes; bytes not met before get the next free ones."""
        for byte in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[byte] < 0:
                self.column[byte] = len(self.bytes)
                self.bytes.append(byte)
        if (more := len(self.bytes) - self.next.shape[1]) > 0:
            self.next = np.pad(self.next, ((0, 0), (0, max(more, 128))), constant_values=-1)
            self.emits = np.pad(self.emits, ((0, 0), (0, max(more, 128)), (0, 0)))
        return self.column[data].astype(np.uint8)

    def merged(self, parts: list[int]) -> list[int]:
        while len(parts) > 1:
            found = [(self.ranks.get(p, (sys.maxsize, -1)), i) for i, p in enumerate(zip(parts, parts[1:]))]
            (rank, token), i = min(found)
            if token < 0:
                break
            parts[i : i + 2] = [token]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b yields just these two; a < 0 is no token."""
        known = self.fits.get((a, b))
        if known is None:
            known = self.merged([*self.parts.get(a, ()), *self.parts[b]]) == ([b] if a < 0 else [a, b])
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[a, b] = known
        return known

    def compile(self, state: int, column: int) -> None:
        """Add the edge that reads a column's byte in a state."""
        byte = self.bytes[column]
        places, here, end = [], None, None
        for node, token, count in self.states[state]:
            child = self.trie[node][0].get(byte)
            if child is None:
                continue
            children, (mid, close) = self.trie[child]
            if here is None and mid >= 0 and self.follows(token, mid):
                here = (mid, count + 1)
            if end is None and close >= 0 and self.follows(token, close):
                end = count + 1
            if children:
                places.append((child, token, count))
        token, count = here
        made = (*((n, t, c - count) for n, t, c in places), (0, token, 0))
        to = self.ids.get(made)
        if to is None:
            to = self.ids[made] = len(self.states)
            self.states.append(made)
            if to == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)])
        self.next[state, column], self.emits[state, column] = to, (count, end)

    def run(self, states: np.ndarray, data: np.ndarray, ends: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Read the columns of ``data`` together, a row of bytes at a time.

        Writes what each edge emits to ``out`` and returns the states reached.
        A word's end leads to the start.
        """
        for byte, end, emitted in zip(data, ends, out):
            to = self.next[states, byte]
            if (new := to < 0).any():
                for key in np.unique(states[new].astype(np.int64) * 256 + byte[new]).tolist():
                    self.compile(*divmod(key, 256))
                to = self.next[states, byte]
            emitted[:] = self.emits[states, byte, end.view(np.uint8)]
            to[end] = START
            states = to
        return states

    def emitted(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens emitted at each byte of a stream of words.

        The stream is cut into chunks of one length, whatever lies at the cut.
        Behind its first word end a chunk's state map is constant, so all
        chunks run side by side from the start state. The maps are then
        composed: each chunk's part up to its first word end is read again from
        the state that the chunks before it lead to. Chunks without a word end
        pass their entry on, so these rounds go on until no exit changes.
        """
        n = len(data)
        columns = -(-n // CHUNK)
        pad = columns * CHUNK - n
        grid = np.append(data, np.zeros(pad, np.uint8)).reshape(columns, CHUNK).T.copy()
        stop = np.append(ends, np.zeros(pad, bool)).reshape(columns, CHUNK).T.copy()
        out = np.zeros((CHUNK, columns), self.small)
        exits = self.run(np.zeros(columns, np.int32), grid, stop, out)
        closed = stop.any(axis=0)
        head = np.where(closed, stop.argmax(axis=0) + 1, CHUNK)
        entries = np.zeros(columns, np.int32)
        while True:
            due = np.append(np.int32(START), exits[:-1])
            again = np.flatnonzero(due != entries)
            if not len(again):
                break
            entries = due
            order = again[head[again].argsort()[::-1]]
            states, done = due[order], 0
            while len(order):
                # Columns end at different rows; those that are through drop out.
                upto = head[order[-1]]
                part = out[done:upto, order]
                states = self.run(states, grid[done:upto, order], stop[done:upto, order], part)
                out[done:upto, order] = part
                over = head[order] <= upto
                whole = over & ~closed[order]
                exits[order[whole]] = states[whole]
                order, states, done = order[~over], states[~over], upto
        return out.T.reshape(-1)[:n]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        if len(self.states) > MAX_STATES:
            self.reset()
        extra = np.zeros(len(texts), np.int64)
        clean = []
        for k, text in enumerate(texts):
            if any(s in text for s in self.special):
                text, extra[k] = self.cut.subn(" ", text)
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            clean.append(text.replace("Σ", "σ").lower())
        # A space before each text parts it from the one before.
        whole = " " + " ".join(clean) + " "
        first = np.cumsum([0, *(len(c) + 1 for c in clean)])
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        kind = character_classes()[points]
        starts = word_starts(points, kind)
        opens = (data & 0xC0) != 0x80
        char = np.cumsum(opens) - 1
        fresh = opens & starts[char]
        ends = np.append(fresh[1:], True)
        kept = kind[char] != SPACE
        text_of_byte = np.searchsorted(first, char[kept], side="right") - 1
        emitted = self.emitted(self.columns(data[kept]), ends[kept])
        return extra + np.bincount(text_of_byte, emitted, len(texts)).round().astype(np.int64)[: len(texts)]


def word_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a word or a space starts at each character.

    Words are runs of letters, single numbers, and runs of anything else. A
    run that starts with an apostrophe gives way to one of the fixed endings.
    """
    starts = np.append(True, kind[1:] != kind[:-1]) | (kind == NUMBER) | (kind == SPACE)
    at = np.flatnonzero((points == ord("'")) & np.append(True, kind[:-1] != OTHER))
    at = at[at + 2 < len(points)]
    one, two = points[at + 1], points[at + 2]
    # The endings 's 't 'm 'd and 're 've 'll.
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    starts[at[short | long] + 1] = False
    starts[at[short] + 2] = True
    behind = at[long] + 3
    starts[behind[behind < len(starts)]] = True
    return starts


@lru_cache(maxsize=2)
def transducer(path: str) -> CountTransducer:
    """A worker compiles a tokenizer once."""
    return CountTransducer(path)


def count_tokens(
    docs: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    ``vocabulary_path`` names a BPE tokenizer file with an end-of-word suffix,
    composed and lower-cased text and white space dropped; it must exist on
    every executor, as installed packages do. Null and empty texts have no
    bytes and no tokens. Rows are independent: nothing is shuffled, repeated
    rows and ids repeat, an empty table gives an empty result, and other
    columns, whatever their names, are not read.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary_path)
        for batch in batches:
            found = [machine.counts(texts) for texts in in_parts(batch.column(1))]
            n = np.concatenate(found) if found else np.zeros(0, np.int64)
            size = pa.compute.binary_length(batch.column(1).cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n), pa.array(n > limit)], names=schema.names
            )

    rows = docs.select(docs[id_col].cast("long").alias(id_col), text_of(text_col).alias("text"))
    return rows.mapInArrow(count, schema)
