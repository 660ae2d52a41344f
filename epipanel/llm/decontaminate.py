"""Benchmark decontamination: an FM-index of each shard of the corpus, searched for test phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .support import ascii_lower, released, small_batches, stage, text_of

WINDOW = 10            # words of a test phrase
PHRASES = 100_000      # phrases searched in one pass over the corpus, at most; more take further passes
SHARD_WORDS = 1 << 20  # words of a shard
ROWS = 1 << 14         # rows of a shard, at most
PIECE = 64             # phrases that begin in one piece of a shard
PART_BYTES = 4_000_000   # of a text taken apart at once
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WORD_IN_TEXT = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
SPANS = "array<struct<first:int,last:int,start:int,end:int>>"


def test_windows(tests: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, phrase) of every ``window`` words of a test text, joined by spaces; a shorter text is one phrase."""
    words = F.array_remove(F.split(ascii_lower(text_of(text_col)), GAPS, -1), "")
    rows = tests.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    at = rows.select("item", "w", F.explode(starts).alias("i"))
    return at.select("item", F.array_join(F.slice("w", F.col("i"), window), " ").alias("phrase")).distinct()


class Phrases:
    """Test phrases as numbers: the words they hold, from 1 on, and a row of them for each phrase."""

    def __init__(self, ids: list[int], phrases: list[str]):
        split = [p.encode().split(b" ") for p in phrases]
        self.words: dict[bytes, int] = {}
        for w in (w for p in split for w in p):
            self.words.setdefault(w, len(self.words) + 1)
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array([len(p) for p in split], np.int64)
        self.shortest, self.longest = int(self.sizes.min()), int(self.sizes.max())
        self.rows = np.zeros((len(split), self.longest), np.int64)
        for row, p in zip(self.rows, split):
            row[self.longest - len(p) :] = [self.words[w] for w in p]

    def numbers(self, text: bytes) -> np.ndarray:
        """The words of a text; 0 for those that no phrase has."""
        words = WORD.findall(text.lower())
        return np.fromiter(map(self.words.get, words, repeat(0)), np.int32, len(words))


def chunks(text: bytes) -> Iterator[bytes]:
    """A text in parts that end between words, unless a word alone is longer."""
    at = 0
    while at < len(text):
        end = min(at + PART_BYTES, len(text))
        if end < len(text):
            inside = WORD.match(text[end : end + PART_BYTES].lower())
            if inside:
                end += inside.end()
        yield text[at:end]
        at = end


class Shard:
    """Words of several texts, or a part of one, gathered until there are enough for an index."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.rows, self.firsts, self.numbers, self.size = phrases, [], [], [], 0

    def add(self, row: int, first: int, numbers: np.ndarray) -> None:
        self.rows.append(row)
        self.firsts.append(first)
        self.numbers += [numbers, np.zeros(1, np.int32)]
        self.size += len(numbers) + 1

    def pieces(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the pieces to index.

        Words that no phrase has end a piece; runs shorter than every phrase
        are left out. Long runs are cut so that each phrase lies in one piece
        as a whole: a piece goes on for a phrase less one word.
        """
        edges = np.flatnonzero(np.diff(np.concatenate([[False], words != 0, [False]])))
        start, size = edges[::2], edges[1::2] - edges[::2]
        long_enough = size >= self.phrases.shortest
        start, size = start[long_enough], size[long_enough]
        beyond = self.phrases.longest - 1
        parts = np.maximum(1, -(-(size - beyond) // PIECE))
        turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(start, parts) + turn * PIECE
        return begin, np.minimum(PIECE + beyond, np.repeat(start + size, parts) - begin)

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, phrase and first word of every occurrence. The shard is empty afterwards."""
        words = np.concatenate(self.numbers)
        entry = np.cumsum([0, *[len(x) + 1 for x in self.numbers[::2]]])[:-1]
        rows, firsts = np.array(self.rows), np.array(self.firsts)
        self.rows, self.firsts, self.numbers, self.size = [], [], [], 0
        none = np.zeros(0, np.int64)
        begin, size = self.pieces(words)
        if not len(begin):
            return none, none, none
        offset = np.cumsum(size + 1) - (size + 1)
        text = np.zeros(int(size.sum()) + len(size), np.int64)
        inside = np.arange(int(size.sum()))
        before = np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(offset, size) + inside - before] = words[np.repeat(begin, size) + inside - before]
        del inside, before
        index = FMIndex(text, len(self.phrases.words) + 1)
        low, high = index.backward(self.phrases.rows, self.phrases.sizes)
        found = np.flatnonzero(low < high)
        if not len(found):
            return none, none, none
        times = (high - low)[found]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[found], times)
        place = index.locate(at)
        piece = np.searchsorted(offset, place, "right") - 1
        origin = begin[piece] + place - offset[piece]
        of = np.searchsorted(entry, origin, "right") - 1
        return rows[of], np.repeat(found, times), firsts[of] + origin - entry[of]


def merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Half-open spans that overlap or touch, as one."""
    order = np.argsort(first, kind="stable")
    first, upto = first[order], np.maximum.accumulate(last[order])
    cut = np.flatnonzero(first[1:] > upto[:-1])
    return list(zip(first[np.concatenate([[0], cut + 1])].tolist(), upto[np.concatenate([cut, [len(first) - 1]])].tolist()))


def uid_of(id_col: str, text_col: str) -> Column:
    return F.sha2(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_of(text_col)), 256)


def one_pass(docs: DataFrame, phrases: Phrases, id_col: str, text_col: str, shard_words: int) -> DataFrame:
    """(uid, id, n_words, spans, phrases) of every row, for phrases that may be broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)     # at most PHRASES rows

    def told(batch: pa.RecordBatch, n_words: np.ndarray, at: np.ndarray, which: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        """A batch's rows with the occurrences in them; ``at`` is sorted."""
        texts = batch.column("text")
        spans: list[list] = [[] for _ in range(batch.num_rows)]
        ids: list[list[int]] = [[] for _ in range(batch.num_rows)]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
        for a, b in zip(edges[:-1], edges[1:]) if len(at) else ():
            row, sizes = int(at[a]), shared.value.sizes[which[a:b]]
            words = [m.span() for m in WORD_IN_TEXT.finditer(texts[row].as_py().decode("utf-8", "surrogateescape"))]
            spans[row] = [
                {"first": f, "last": t, "start": words[f][0], "end": words[t - 1][1]} for f, t in merged(first[a:b], first[a:b] + sizes)
            ]
            ids[row] = np.unique(shared.value.ids[which[a:b]]).tolist()
        return pa.RecordBatch.from_arrays(
            [batch.column("uid"), batch.column("id"), pa.array(n_words),
             pa.array(spans, pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")]))),
             pa.array(ids, pa.list_(pa.int64()))],
            names=["uid", "id", "n_words", "spans", "phrases"],
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        shard, found, waiting, rows, words = Shard(phrases), [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            """The rows that wait, once all their words have been searched."""
            if shard.size:
                found.append(shard.search())
            at, which, first = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
            order = np.argsort(at, kind="stable")
            at, which, first = at[order], which[order], first[order]
            base = 0
            for batch, n_words in waiting:
                a, b = np.searchsorted(at, [base, base + batch.num_rows])
                yield told(batch, n_words, at[a:b] - base, which[a:b], first[a:b])
                base += batch.num_rows
            found.clear()
            waiting.clear()

        for batch in released(batches):
            n_words = np.zeros(batch.num_rows, np.int64)
            for row in range(batch.num_rows):
                tail = np.zeros(0, np.int32)
                for part in chunks(batch.column("text")[row].as_py()):
                    # A phrase may begin in the words before this part.
                    numbers = np.concatenate([tail, phrases.numbers(part)])
                    shard.add(rows + row, n_words[row] - len(tail), numbers)
                    n_words[row] += len(numbers) - len(tail)
                    tail = numbers[max(0, len(numbers) - phrases.longest + 1) :]
                    if shard.size >= shard_words:
                        found.append(shard.search())
            waiting.append((batch, n_words))
            rows, words = rows + batch.num_rows, words + int(n_words.sum())
            if words >= shard_words or rows >= ROWS:
                yield from flush()
                rows = words = 0
        yield from flush()

    rows = small_batches(docs).select(uid_of(id_col, text_col).alias("uid"), F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(search, f"uid string, id long, n_words long, spans {SPANS}, phrases array<long>")


def spans_merged(spans: Column) -> Column:
    """Spans of several passes, as ``merged`` does it."""

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"),
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
        )
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= s["first"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.expr(f"cast(array() as {SPANS})"), add)


class Leaks:
    """Occurrences of test phrases in a corpus."""

    def __init__(
        self, docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        item_col: str = "item_id", item_text_col: str = "text",
        *, window: int = WINDOW, most_phrases: int = PHRASES, shard_words: int = SHARD_WORDS,
    ):
        """Words are runs of digits, letters (A-Z in lower case) and characters beyond ASCII.

        A phrase is ``window`` consecutive words of a test text; a shorter text
        is one phrase. Of each part of the corpus an FM-index is built in its
        task, over the words that phrases have, and searched backwards for
        every phrase; occurrences are located by sampled suffix positions and
        merged to spans. Memory is bounded by a shard and by ``most_phrases``,
        whatever the length of a text or the number of tests: more phrases take
        further passes, and a text may fill several shards.

        Null and empty texts have no words. Test rows without an id take no
        part; several rows of one id are one item. Repeated rows of the corpus
        are answered each, rows without an id too. Other columns, whatever their
        names, are not read. Empty tables give empty results, and a corpus
        without tests has no hits.
        """
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        windows = stage(test_windows(tests, window, item_col, item_text_col))
        named = stage(windows.select("phrase").distinct().withColumn("pid", F.monotonically_increasing_id()))
        self.items = stage(windows.join(named, "phrase").select("pid", "item"))
        passes, part = 0, F.lit(0)
        while passes == 0 or named.groupBy(part.alias("part")).count().where(F.col("count") > most_phrases).count():
            passes = passes * 2 or -(-named.count() // most_phrases) or 1
            part = F.pmod(F.xxhash64("pid"), F.lit(passes))
        told = []
        for i in range(passes):
            rows = named.where(part == i).select("pid", "phrase").toArrow()     # at most ``most_phrases``
            if rows.num_rows:
                phrases = Phrases(rows.column("pid").to_pylist(), rows.column("phrase").to_pylist())
                told.append(one_pass(docs, phrases, id_col, text_col, shard_words))
        if told:
            first = stage(told[0])
            later = [stage(t.where(F.size("phrases") > 0).dropDuplicates(["uid"])) for t in told[1:]]
            self.rows = self._combined(first, later) if later else first
        else:
            words = F.array_remove(F.split(ascii_lower(text_of(text_col)), GAPS, -1), "")
            self.rows = docs.select(
                uid_of(id_col, text_col).alias("uid"), F.col(id_col).cast("long").alias("id"), F.size(words).cast("long").alias("n_words"),
                F.expr(f"cast(array() as {SPANS})").alias("spans"), F.expr("cast(array() as array<long>)").alias("phrases"),
            )

    @staticmethod
    def _combined(first: DataFrame, later: list[DataFrame]) -> DataFrame:
        more = later[0]
        for t in later[1:]:
            more = more.union(t)
        # As many lists a row as there are passes.
        found = more.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("phrases")).alias("p"))
        none = F.expr(f"cast(array() as {SPANS})"), F.expr("cast(array() as array<long>)")
        return stage(
            first.join(found, "uid", "left").select(
                "uid", "id", "n_words", spans_merged(F.concat("spans", F.coalesce("s", none[0]))).alias("spans"),
                F.concat("phrases", F.coalesce("p", none[1])).alias("phrases"),
            )
        )

    def report(self) -> DataFrame:
        """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every row of the corpus.

        Rows with the same set of phrases are answered once: a passage that
        many documents share meets its test items in one row.
        """
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
        rows = self.rows.select("id", "n_words", n_hit.alias("n_hit"), "spans", F.array_sort("phrases").alias("phrases"))
        hit = rows.where("n_hit > 0").withColumn("set", F.sha2(F.array_join(F.transform("phrases", lambda p: p.cast("string")), ","), 256))
        sets = hit.select("set", "phrases").dropDuplicates(["set"]).select("set", F.explode("phrases").alias("pid"))
        by_set = sets.join(self.items, "pid").select("set", "item").distinct().groupBy("set").agg(F.array_sort(F.collect_list("item")).alias("items"))
        told = stage(by_set.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
        columns = [F.col("id").alias(self.id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans"]
        clean = rows.where("n_hit = 0").withColumns({"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)})
        return hit.join(told, "set").select(*columns).unionByName(clean.select(*columns))

    def removed(self) -> DataFrame:
        """The corpus with its own columns, the spans cut out of the texts."""
        cuts = self.rows.where(F.size("phrases") > 0).select(F.col("uid").alias("__uid__"), F.col("spans").alias("__cut__")).dropDuplicates(["__uid__"])
        text, n = F.col(self.text_col), F.size("__cut__")
        before = F.transform("__cut__", lambda s, i: F.struct(
            F.when(i > 0, F.get(F.col("__cut__"), i - 1)["end"]).otherwise(0).alias("from"), s["start"].alias("to")
        ))
        pieces = F.transform(before, lambda s: F.substr(text, s["from"] + 1, s["to"] - s["from"]))
        rest = F.substr(text, F.element_at("__cut__", n)["end"] + 1)
        cut = F.when(n > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
        joined = self.docs.withColumn("__own__", uid_of(self.id_col, self.text_col)).join(cuts, F.col("__own__") == F.col("__uid__"), "left")
        return joined.withColumn(self.text_col, cut).select(*self.docs.columns)
