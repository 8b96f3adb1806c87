"""Benchmark decontamination by seeds and local alignment.

Words are case-folded runs of word characters. Every three words of a test item within ``REACH``
words are a seed, however common, and meet the same three words within as many words of a text.
Three matches in a row without a seed have three edits between them or more, so that m matches
without any seed score at most m / 4 + 1.5: too little for items of 11 to 57 words. For other
items three words within ``FAR`` are seeds: without any of these an alignment scores 2 at most,
too little from 6 words on. Where a text shares a seed with an item, the item is aligned by
Smith-Waterman with all parts of the text that have enough of the item's words for a copy (which
loses nothing either), so that the copies are those of whole texts' alignments. A score of 0.4
of the item's length, or of 16 words, makes a passage a copy; chance alignments reach a third of
short items and some seven words of long ones.

Every whole text is searched. Test items go to the tasks in blocks of bounded size, each block
against all documents.

Defined results: items without words (null and empty ones too) match nothing; items of one or two
words match texts that consist of just these words, as chance can't be told from copying within
others; items of up to five words match only where a text shares three of them; equal items are
all reported; of equally good copies in a text the first is; null and empty texts match nothing;
very long texts and items are aligned whole; repeated documents are reported each; ids may be of
any type; further columns of the documents pass through a filter and are not read otherwise;
empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from kelpie.llm.common import stored, texts_of, tidy

WORD = re.compile(r"\w+")
GRAM, REACH, FAR = 3, 5, 6
#: Size of the hash table that most grams of texts end at, as a power of two.
SLOT_BITS = 22
MATCH, MISMATCH, GAP = 1.0, -0.5, 0.5
#: Share of an item's words, as an alignment score, from which a passage is a copy; so many words are enough of any item.
THRESHOLD, ENOUGH = 0.4, 16.0
#: Words of test items in a block, about.
BLOCK_WORDS = 1_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def needed(n: int, threshold: float = THRESHOLD) -> float:
    """The alignment score that makes a passage a copy of an item of n words."""
    return min(threshold * n, ENOUGH)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of an item within a passage, and where in the passage it ends."""
    n = len(passage)
    slope = GAP * np.arange(n + 1)
    row, best, end = np.zeros(n + 1), 0.0, 0
    for w in item:
        new = np.maximum(0.0, row - GAP)
        np.maximum(new[1:], row[:-1] + np.where(passage == w, MATCH, MISMATCH), out=new[1:])
        row = np.maximum.accumulate(new + slope) - slope  # gaps along the passage
        k = int(row.argmax())
        if row[k] > best:
            best, end = float(row[k]), k
    return best, end


@dataclass
class Block:
    """Some test items, by word numbers from 1; 0 is any other word."""

    vocabulary: dict[str, int]
    items: list[np.ndarray]
    ids: list[list]
    #: Of each seed in order: its gram and, from starts on, the items that hold it.
    seeds: np.ndarray
    starts: np.ndarray
    holders: np.ndarray
    #: Which slots of a hash table have seeds.
    slots: np.ndarray
    #: Words that the seeds of any item lie within.
    reach: int
    threshold: float = THRESHOLD
    #: Ids of items of fewer words than a seed, by these words.
    short: dict[tuple, list] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple], threshold: float = THRESHOLD) -> Block:
        by_words, short = defaultdict(list), defaultdict(list)
        for i, t in rows:
            w = tuple(words_of(t))
            if w:
                (by_words if len(w) >= GRAM else short)[w].append(i)
        vocabulary: dict[str, int] = {}
        items = [np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], np.int64) for w in by_words]
        # matches without a seed within REACH score a quarter and 1.5 at most
        reaches = [REACH if len(x) / 4 + 1.5 < needed(len(x), threshold) else FAR for x in items]
        pairs = [(g := np.unique(cls._grams(x, len(vocabulary) + 1, r)), np.full(len(g), k)) for k, (x, r) in enumerate(zip(items, reaches, strict=True))] or [(np.zeros(0, np.int64),) * 2]
        grams, holders = (np.concatenate(x) for x in zip(*pairs, strict=True))
        whole = grams % (len(vocabulary) + 1) > 0  # at an item's end there are no further words
        grams, holders = grams[whole], holders[whole]
        order = np.lexsort((holders, grams))
        seeds, starts = np.unique(grams[order], return_index=True)
        slots = np.zeros(1 << SLOT_BITS, bool)
        slots[cls._slots(seeds)] = True
        return cls(vocabulary, items, list(by_words.values()), seeds, np.append(starts, len(grams)), holders[order], slots, max(reaches, default=REACH), threshold, dict(short))

    @staticmethod
    def _grams(w: np.ndarray, base: int, reach: int) -> np.ndarray:
        """Numbers of all three words within reach, of any words. A block's vocabulary is small enough for 63 bits."""
        i, j = np.triu_indices(reach - 1, 1)
        near = np.lib.stride_tricks.sliding_window_view(np.append(w, np.zeros(reach - 1, np.int64)), reach)
        return ((near[:, :1] * base + near[:, i + 1]) * base + near[:, j + 1]).ravel()

    @staticmethod
    def _slots(grams: np.ndarray) -> np.ndarray:
        return (grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(x, 0) for x in words], np.int64)

    def met(self, w: np.ndarray, step: int = 1 << 14) -> list[int]:
        """The items that share a seed with a text."""
        g = []
        for lo in range(0, len(w), step):
            own = self._grams(w[lo : lo + step + self.reach - 1], len(self.vocabulary) + 1, self.reach)
            g.append(own[self.slots[self._slots(own)]])
        g = np.unique(np.concatenate(g))
        at = np.minimum(np.searchsorted(self.seeds, g), len(self.seeds) - 1)
        at = at[self.seeds[at] == g]
        return np.unique(np.concatenate([self.holders[self.starts[s] : self.starts[s + 1]] for s in at.tolist()])).tolist() if len(at) else []

    def parts(self, w: np.ndarray, met: list[int], cells: int = 1 << 20) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Items, and where in a text their copies can lie: each word of it adds what it can at most, and no alignment's beginning falls to 0."""
        own, back = np.unique(w, return_inverse=True)
        kind = np.float32 if len(w) < 1 << 22 else np.float64  # both hold such sums of halves exactly
        held = np.zeros(len(self.vocabulary) + 1, bool)
        held[own] = True
        met = [k for k in met if np.count_nonzero(held[self.items[k]]) * MATCH >= needed(len(self.items[k]), self.threshold) - 1e-9]
        step = max(1, cells // (len(w) + 1))
        for lo in range(0, len(met), step):
            some = met[lo : lo + step]
            words = np.concatenate([self.items[k] for k in some])
            who = np.repeat(np.arange(len(some)), [len(self.items[k]) for k in some])
            at = np.minimum(np.searchsorted(own, words), len(own) - 1)
            worth = np.full((len(some), len(own)), MISMATCH, kind)
            same = own[at] == words
            worth[who[same], at[same]] = MATCH
            total = np.zeros((len(some), len(w) + 1), kind)
            np.cumsum(worth[:, back], 1, out=total[:, 1:])
            above = total - np.minimum.accumulate(total, 1)
            least = np.array([needed(len(self.items[k]), self.threshold) for k in some]) - 1e-9
            for x in np.flatnonzero(above.max(1) >= least).tolist():
                zero, out = np.append(np.flatnonzero(above[x] == 0), len(w)), []
                for y in np.flatnonzero(above[x] >= least[x]).tolist():
                    if not out or y > out[-1][1]:
                        z = int(np.searchsorted(zero, y))
                        out.append((int(zero[z - 1]), int(zero[z])))
                yield some[x], out

    def leaks(self, text: str) -> list[tuple[list, float, int, int]]:
        """(ids, score, first word, words) of each item that the text holds a copy of."""
        words = words_of(text)
        if len(words) < GRAM:
            found = self.short.get(tuple(words))
            return [(found, 1.0, 0, len(words))] if found else []
        w, out = self.numbers(words), []
        for k, parts in self.parts(w, self.met(w)) if self.items else ():
            item = self.items[k]
            least = needed(len(item), self.threshold)
            best = (0.0, 0, 0)
            for a, z in parts:
                score, end = align(item, w[a:z])
                if score > best[0]:
                    best = (score, a, end)
            if best[0] >= least - 1e-9:
                score, a, end = best
                length = align(item[::-1], w[a : a + end][::-1])[1]
                out.append((self.ids[k], score / len(item) / MATCH, a + end - length, length))
        return out


def blocks_of(benchmark: DataFrame, threshold: float = THRESHOLD) -> Iterator[Block]:
    """Items block by block; a block's rows, of bounded length together, come to the driver one at a time."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"] or "") // 6 + 1
        if size >= BLOCK_WORDS:
            yield Block.of(rows, threshold)
            rows, size = [], 0
    if rows:
        yield Block.of(rows, threshold)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word, n_words: each document's best copy of each item."""
    spark, out = docs.sparkSession, None
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    arrow = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {doc_kind}, item_id {item_kind}, score double, first_word long, n_words long"
    for block in blocks_of(benchmark, threshold):
        if block.items or block.short:
            shared = spark.sparkContext.broadcast(block)

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                own = shared.value
                for b in batches:
                    rows = [(i, item, *x[1:]) for i, t in enumerate(texts_of(b)) for x in own.leaks(t) for item in x[0]]
                    cols = list(zip(*rows, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], arrow), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["doc_id", "item_id", "score", "first_word", "n_words"])

            found = docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold a copy of no item, all columns as they are."""
    for k, block in enumerate(blocks_of(benchmark, threshold)):
        if block.items or block.short:
            docs = stored(docs, "decontaminated") if k else docs
            shared = docs.sparkSession.sparkContext.broadcast(block)

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield b.filter(pa.array([not shared.value.leaks(t) for t in texts_of(b)], pa.bool_()))

            docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
