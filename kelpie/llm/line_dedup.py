"""Corpus-wide line deduplication that can be undone.

State is an exact reference-count table (how many documents hold a line key) and, per shard of
the key space, a cuckoo filter of the live keys, those held by at least ``min_docs`` documents.
Documents can be inserted and deleted: counts move, and only keys that cross the threshold
enter or leave their shard's filter. Each shard also lists the counted keys that its filter
would hit wrongly, so that for inserted documents the filter's answer is exact. Filters that are
small together go to every task; larger ones stay, and the documents' distinct keys go to the
tasks that hold their shards. Shards split in two as live keys grow.

The index lives in its folder: generations of tables, and a marker written last that says how
many shards the generation has; a change that breaks off leaves the old generation, and a new
``LineIndex`` on the folder goes on where the last one ended.

Defined results: null or empty text is one empty line, which is never dropped; a line that is
only white space has the empty key and stays; very long texts are split whole; repeated rows
count once each as documents; deleting documents that were never inserted raises and changes
nothing, as far as counts can tell; an empty table gives an empty result; columns ``n_lines`` and
``n_dropped`` of the input are replaced, further ones pass through untouched.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import shared_dir, stored, texts_of, tidy
from kelpie.operators.joins import skew_join

WHITE = b" \t\n\v\f\r"
SLOTS = 4
#: All filters together are handed to every task up to this size; beyond it keys go to their shards.
MAX_FILTER_BYTES = 64 << 20
#: Live keys of a shard, at most about, and shards at first; a task holds one shard's filter at a time.
KEYS_PER_SHARD, SHARDS = 1_000_000, 8
#: Documents of one text in one task, where texts meet what was found of them.
HOT_TEXTS = 10_000


def line_keys(text: str) -> list[bytes]:
    """Keys of the lines: ASCII white space stripped, A-Z lower-cased (bytes.lower is ASCII only)."""
    return [x.strip(WHITE).lower() for x in text.encode("utf-8", "surrogatepass").split(b"\n")]


def digests(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two int64."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


class CuckooFilter:
    """Partial-key cuckoo filter, four 32-bit fingerprints a bucket, operations on arrays of keys."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.mask = np.uint64(len(slots) - 1)

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint32))

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint32).reshape(-1, SLOTS).copy())

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = keys.view(np.uint64)
        fp = (u[:, 1] >> np.uint64(32)).astype(np.uint32)
        fp[fp == 0] = 1
        return fp, ((u[:, 0] >> np.uint64(20)) & self.mask).astype(np.int64)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ ((fp.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7)) & self.mask).astype(np.int64)

    def insert(self, keys: np.ndarray, rounds: int = 500) -> bool:
        """False when the filter is too full: the caller rebuilds the shard larger."""
        fp, at = self._places(keys)
        rng = np.random.default_rng(7)
        for _ in range(rounds):
            if not len(fp):
                return True
            for _ in range(2):  # either bucket: the r-th newcomer of a bucket takes its r-th free slot
                order = np.argsort(at, kind="stable")
                fp, at = fp[order], at[order]
                first = np.r_[True, at[1:] != at[:-1]]
                rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                free = self.slots[at] == 0
                fits = rank < free.sum(1)
                slot = np.argmax(np.cumsum(free, 1) == (rank + 1)[:, None], 1)
                self.slots[at[fits], slot[fits]] = fp[fits]
                fp, at = fp[~fits], at[~fits]
                if not len(fp):
                    return True
                at = self._other(at, fp)
            _, one = np.unique(at, return_index=True)  # one eviction a bucket and round
            slot = rng.integers(0, SLOTS, len(one))
            out = self.slots[at[one], slot].copy()
            self.slots[at[one], slot] = fp[one]
            fp[one] = out
            at = at.copy()
            at[one] = self._other(at[one], out)
        return not len(fp)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, at = self._places(keys)
        return (self.slots[at] == fp[:, None]).any(1) | (self.slots[self._other(at, fp)] == fp[:, None]).any(1)

    def delete(self, keys: np.ndarray) -> None:
        """Take one copy of each key's fingerprint out; the keys must be in."""
        fp, at = self._places(keys)
        for _ in range(2):  # the r-th of equal fingerprints in a bucket takes its r-th copy out
            if not len(fp):
                return
            order = np.lexsort((fp, at))
            fp, at = fp[order], at[order]
            first = np.r_[True, (at[1:] != at[:-1]) | (fp[1:] != fp[:-1])]
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            held = self.slots[at] == fp[:, None]
            there = rank < held.sum(1)
            slot = np.argmax(np.cumsum(held, 1) == (rank + 1)[:, None], 1)
            self.slots[at[there], slot[there]] = 0
            fp, at = fp[~there], at[~there]
            at = self._other(at, fp)


class Probe:
    """All shards in memory, for one task."""

    def __init__(self, shards: dict[int, tuple[bytes, bytes]], n_shards: int):
        self.n = n_shards
        self.filters = {k: CuckooFilter.from_bytes(v[0]) for k, v in shards.items()}
        self.wrong = {k: {bytes(v[1][i : i + 16]) for i in range(0, len(v[1]), 16)} for k, v in shards.items()}  # hi and lo, big-endian

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(keys), bool)
        shard = keys[:, 0].view(np.uint64) % np.uint64(self.n)
        for k in np.unique(shard):
            if f := self.filters.get(int(k)):
                own = np.flatnonzero(shard == k)
                own = own[f.contains(keys[own])]
                if wrong := self.wrong[int(k)]:
                    own = np.array([i for i in own if keys[i].astype(">i8").tobytes() not in wrong], np.int64)
                hit[own] = True
        return hit


def shard_column(n_shards: int):
    """The unsigned remainder of hi, as Probe takes it; a power of two, so that shards split in two."""
    return F.col("hi").bitwiseAND(F.lit(n_shards - 1).cast("long")).cast("int").alias("shard")


class LineIndex:
    """Incremental index in a shared folder; each change makes a new generation beside the old."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 10):
        self.spark, self.path, self.min_docs = spark, path or shared_dir(spark, "lines"), min_docs
        self._fs, self._root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        if (made := self.state.get("min_docs", min_docs)) != min_docs:  # its filters hold the keys of that bound
            raise ValueError(f"the index in {self.path} was made with min_docs={made}, not {min_docs}")

    @property
    def state(self) -> dict:
        """Of the latest whole generation: its number, the name of its tables, how many shards it has."""
        found = self._fs.get_file_info(pafs.FileSelector(f"{self._root}/_state", allow_not_found=True))
        names = [f.path for f in found if f.base_name.endswith(".json")]
        if not names:
            return {"generation": 0, "name": "", "shards": 0}
        with self._fs.open_input_file(max(names)) as f:
            return json.loads(f.read())

    def _mark(self, state: dict) -> None:
        self._fs.create_dir(f"{self._root}/_state", recursive=True)
        name = f"{self._root}/_state/{state['generation']:08d}"
        with self._fs.open_output_stream(f"{name}.{state['name']}") as f:
            f.write(json.dumps(state).encode())
        self._fs.move(f"{name}.{state['name']}", f"{name}.json")

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/counts-{self.state['name']}")

    @property
    def filters(self) -> DataFrame:
        """shard, slots, wrong (the counted keys below the threshold that the filter hits)."""
        return self.spark.read.parquet(f"{self.path}/filters-{self.state['name']}")

    @staticmethod
    def _document_keys(docs: DataFrame) -> DataFrame:
        """(hi, lo, n): in how many documents of an input batch a key occurs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys: list[bytes] = []
                for t in texts_of(b):
                    keys += {k for k in line_keys(t) if k}
                d = pd.DataFrame(digests(keys), columns=["hi", "lo"]).groupby(["hi", "lo"]).size()
                hi, lo = (d.index.get_level_values(i).to_numpy(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(d.to_numpy(np.int64))], ["hi", "lo", "n"])

        return docs.select("text").mapInArrow(tidy(run), "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))

    def insert(self, docs: DataFrame) -> None:
        self._change(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        self._change(docs, -1)

    def _change(self, docs: DataFrame, sign: int) -> None:
        before, live, name = self.state, self.min_docs, uuid.uuid4().hex[:12]
        at = lambda what: f"{self.path}/{what}-{name}"
        delta = self._document_keys(docs)
        if before["generation"]:
            new = self.counts.select("hi", "lo", "n", F.lit(0).cast("long").alias("d")).unionByName(delta.select("hi", "lo", F.lit(0).cast("long").alias("n"), (F.col("n") * sign).alias("d")))
            new = new.groupBy("hi", "lo").agg(F.sum("n").alias("old"), (F.sum("n") + F.sum("d")).alias("n"))
        else:
            new = delta.select("hi", "lo", F.lit(0).cast("long").alias("old"), (F.col("n") * sign).alias("n"))
        new.write.parquet(at("change"))
        change = self.spark.read.schema("hi long, lo long, old long, n long").parquet(at("change"))
        n_live, least = change.agg(F.count_if(F.col("n") >= live), F.min("n")).first()
        if (least or 0) < 0:
            raise ValueError("documents were deleted that the index doesn't hold")
        n_shards = max(SHARDS, before["shards"])
        while n_live > n_shards * KEYS_PER_SHARD:
            n_shards *= 2
        change.filter("n > 0").select("hi", "lo", "n").write.parquet(at("counts"))
        counts = self.spark.read.schema("hi long, lo long, n long").parquet(at("counts"))
        schema = "shard int, slots binary, overfull boolean"

        def update(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            shard = int((keys if len(keys) else old)["shard"].iloc[0])
            enter = np.ascontiguousarray(keys.loc[keys["enters"], ["hi", "lo"]].to_numpy(np.int64)) if len(keys) else np.zeros((0, 2), np.int64)
            leave = np.ascontiguousarray(keys.loc[~keys["enters"], ["hi", "lo"]].to_numpy(np.int64)) if len(keys) else np.zeros((0, 2), np.int64)
            f = CuckooFilter.from_bytes(old["slots"].iloc[0]) if len(old) else CuckooFilter.sized(len(enter))
            f.delete(leave)
            full = not f.insert(enter)
            return pd.DataFrame({"shard": [shard], "slots": [f.to_bytes()], "overfull": [full]})

        def rebuild(keys: pd.DataFrame) -> pd.DataFrame:
            own, n = np.ascontiguousarray(keys[["hi", "lo"]].to_numpy(np.int64)), len(keys)
            while not (f := CuckooFilter.sized(n)).insert(own):
                n *= 2
            return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "slots": [f.to_bytes()], "overfull": [False]})

        live_keys = counts.filter(F.col("n") >= live).select(shard_column(n_shards), "hi", "lo")
        if n_shards != before["shards"]:  # the first generation, or shards have split
            part = live_keys.groupBy("shard").applyInPandas(rebuild, schema)
        else:
            crossing = change.filter((F.col("old") >= live) != (F.col("n") >= live)).select(shard_column(n_shards), "hi", "lo", (F.col("n") >= live).alias("enters"))
            part = crossing.groupBy("shard").cogroup(self.filters.select("shard", "slots").groupBy("shard")).applyInPandas(update, schema)
        part.write.parquet(at("part"))
        part = self.spark.read.schema(schema).parquet(at("part"))
        again = [r[0] for r in part.filter("overfull").select("shard").collect()]
        if again:
            part = part.filter(~F.col("shard").isin(again)).unionByName(live_keys.filter(F.col("shard").isin(again)).groupBy("shard").applyInPandas(rebuild, schema))
        part = part.select("shard", "slots")
        light = counts.filter(F.col("n") < live).select("hi", "lo")
        hits = self._hits(light, part, n_shards)
        wrong = hits.groupBy("shard").agg(F.array_join(F.array_sort(F.collect_list(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("hi", "lo"))))), "").alias("wrong"))
        part.join(wrong, "shard", "left").select("shard", "slots", F.unhex(F.coalesce("wrong", F.lit(""))).alias("wrong")).write.parquet(at("filters"))
        self._mark({"generation": before["generation"] + 1, "name": name, "shards": n_shards, "min_docs": live})

    @staticmethod
    def _bytes(filters: DataFrame) -> int:
        return filters.agg(F.sum(F.length("slots"))).first()[0] or 0

    def _hits(self, keys: DataFrame, filters: DataFrame, n_shards: int) -> DataFrame:
        """shard, hi, lo: those of the distinct keys (hi, lo) that their shard's filter holds, without those known to be wrong."""
        own = keys.select(shard_column(n_shards), "hi", "lo")
        if self._bytes(filters) <= MAX_FILTER_BYTES:
            shared = self.spark.sparkContext.broadcast(held(filters))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                probe = Probe(shared.value, n_shards)
                for b in batches:
                    yield b.filter(pa.array(probe(key_rows(b)), pa.bool_()))

            return own.mapInArrow(tidy(run), "shard int, hi long, lo long")

        # a shard's keys are dealt over as many parts as they need, and to each its filter goes ahead of them
        parts = max(1, -(-keys.count() // int(n_shards * max(1, KEYS_PER_SHARD))))
        none = F.lit(None).cast("long")
        heads = with_wrong(filters).select("shard", none.alias("hi"), none.alias("lo"), "slots", "wrong").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        own = own.withColumn("part", F.pmod("lo", F.lit(parts)).cast("int"))
        rows = heads.unionByName(own, allowMissingColumns=True).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("slots").isNull()).drop("part")

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, probe = None, None
            for b in batches:
                shards = b.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    part = b.slice(lo, hi - lo)
                    if not part.num_rows:
                        continue
                    if shard != int(shards[lo]):
                        shard, probe = int(shards[lo]), None
                    # parts of a shard that lie in one task follow one another, each behind its own copy of the filter
                    first = np.flatnonzero(part.column(3).is_valid().to_numpy(zero_copy_only=False)).tolist()
                    for a, z in zip([0, *first], [*first, part.num_rows], strict=True):
                        some = part.slice(a, z - a)
                        if some.num_rows and (slots := some.column(3)[0].as_py()) is not None:
                            probe, some = Probe({shard: (slots, some.column(4)[0].as_py() or b"")}, n_shards), some.slice(1)
                        if probe and some.num_rows:
                            some = some.select([0, 1, 2])
                            yield some.filter(pa.array(probe(key_rows(some)), pa.bool_()))

        return rows.mapInArrow(tidy(probed), "shard int, hi long, lo long")

    def drop(self, docs: DataFrame) -> DataFrame:
        """The documents without lines of live keys: text replaced, n_lines and n_dropped added."""
        return self._drop_here(docs) if self._bytes(self.filters) <= MAX_FILTER_BYTES else self._drop_by_shard(docs)

    def _drop_here(self, docs: DataFrame) -> DataFrame:
        """All filters are in each task."""
        shared, n_shards = self.spark.sparkContext.broadcast(held(self.filters)), self.state["shards"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = Probe(shared.value, n_shards)
            for b in batches:
                per, keys = [], []
                for t in (ts := texts_of(b)):
                    own = line_keys(t)
                    per.append(len(own))
                    keys += own
                gone = probe(digests(keys)) if keys else np.zeros(0, bool)
                gone &= np.fromiter(map(bool, keys), bool, len(keys))
                yield kept_batch(b, ts, per, gone)

        return docs.mapInArrow(tidy(run), kept_schema(docs))

    def _drop_by_shard(self, docs: DataFrame) -> DataFrame:
        """For more live keys than a task can hold: each distinct key asks its shard's filter once.

        What it says goes to the texts that have the key, by the texts' hash: equal texts are one, and ids don't matter.
        """

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own, keys = [], []
                for i, t in zip(b.column("own").to_pylist(), texts_of(b), strict=True):
                    ks = {k for k in line_keys(t) if k}
                    own += [i] * len(ks)
                    keys += ks
                d = digests(keys)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1])], ["own", "hi", "lo"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                per, gone = [], []
                for t, live in zip(ts := texts_of(b), b.column("_live").to_pylist(), strict=True):
                    keys, own = line_keys(t), {(x["hi"], x["lo"]) for x in live or ()}
                    per.append(len(keys))
                    gone += [bool(k) and tuple(d) in own for k, d in zip(keys, digests(keys).tolist(), strict=True)]
                yield kept_batch(b.drop_columns(["_live", "_own"]), ts, per, np.array(gone, bool))

        digest = F.xxhash64(F.coalesce("text", F.lit("")))
        keys = stored(docs.select(digest.alias("own"), "text").mapInArrow(tidy(keyed), "own long, hi long, lo long").distinct(), "line-keys")
        live = self._hits(keys.select("hi", "lo").distinct(), self.filters, self.state["shards"]).select("hi", "lo")
        found = keys.join(live, ["hi", "lo"]).groupBy(F.col("own").alias("_own")).agg(F.collect_set(F.struct("hi", "lo")).alias("_live"))
        # a text that many documents share is dealt over several tasks
        both = skew_join(docs.withColumn("_own", F.xxhash64(F.coalesce(docs["text"], F.lit("")))), found, ["_own"], "left", HOT_TEXTS)
        return both.mapInArrow(tidy(cut), kept_schema(docs))


def with_wrong(filters: DataFrame) -> DataFrame:
    return filters if "wrong" in filters.columns else filters.withColumn("wrong", F.lit(b""))


def held(filters: DataFrame) -> dict[int, tuple[bytes, bytes]]:
    """Filters that are small together, on the driver."""
    return {r["shard"]: (bytes(r["slots"]), bytes(r["wrong"])) for r in with_wrong(filters).collect()}


def key_rows(b: pa.RecordBatch) -> np.ndarray:
    return np.ascontiguousarray(np.stack([b.column("hi").to_numpy(), b.column("lo").to_numpy()], 1))


def kept_schema(docs: DataFrame):
    own = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    schema = type(docs.schema)(own)
    return schema.add("n_lines", "long").add("n_dropped", "long")


def kept_batch(b: pa.RecordBatch, ts: list[str], per: list[int], gone: np.ndarray) -> pa.RecordBatch:
    texts, dropped, at = [], [], 0
    for t, n in zip(ts, per, strict=True):
        own = gone[at : at + n]
        at += n
        k = int(own.sum())
        dropped.append(k)
        texts.append("\n".join(x for x, g in zip(t.split("\n"), own, strict=True) if not g) if k else t)
    names = [x for x in b.schema.names if x not in ("n_lines", "n_dropped")]
    cols = [pa.array(texts, b.schema.field("text").type) if x == "text" else b.column(x) for x in names]
    return pa.RecordBatch.from_arrays([*cols, pa.array(per, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, min_docs: int = 10, path: str | None = None) -> DataFrame:
    """Drop from every document all lines whose key at least min_docs documents hold."""
    index = LineIndex(docs.sparkSession, path, min_docs)
    index.insert(docs)
    return index.drop(docs)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line,
         translate(regexp_replace(parts[i], '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
live AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(live.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE live.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN live ON lines.k = live.k GROUP BY doc_id
"""
