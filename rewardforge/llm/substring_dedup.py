"""Exact repeats of long byte strings by a sampled, bounded-depth suffix sort.

Suffixes only matter to a depth of ``length`` bytes. The steps follow the
difference-cover scheme, with a sample that follows the content:

1. Sample. Every start owns the least-hashed ``tuple_bytes`` tuple inside its
   string (the last of equal ones). Equal strings own tuples at equal offsets,
   which is what a difference cover is for, and about 2 in (length -
   tuple_bytes) positions are sampled instead of 2 in 3. Sampled tuples get
   names by grouping; a name that occurs once marks strings without a repeat.
2. Recurse on names. A sampled position with a repeated name is named again by
   its context, all bytes of the strings that own it. Where a context occurs
   twice, all its strings repeat.
3. Merge the rest. The suffixes of contexts that occur once are put in order
   with those of the same name, by their first ``length`` bytes.
4. Compare neighbours in that order: equal ones are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import by_value, documents, numbered, shuffle_partitions

by_value(__name__)

LENGTH = 200
TUPLE_BYTES = 64
SEGMENT = 1 << 19  # starts handled at once; positions must fit in 20 bits
LARGE_GROUP = 4096  # contexts of one name beyond which their suffixes are dealt out singly
BUCKET = 2048  # contexts that one call sorts
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[size] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, b, dtype=np.uint64)]) for b in (_BASE, inverse))
    return _powers[size]


class _Hashes:
    """Hashes of any substrings of one byte array, from prefix sums."""

    def __init__(self, raw: np.ndarray):
        self.up, down = _power_tables(len(raw))
        self.sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[: len(raw)])]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.up[start])


def sampled(raw: np.ndarray, length: int, tuple_bytes: int) -> tuple[np.ndarray, ...]:
    """Sampled positions of one text: name, context hash, first owner, owners."""
    starts = len(raw) - length + 1
    if starts < 1:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    found = []
    for low in range(0, starts, SEGMENT):  # a context cut at a segment's end is settled in step 3
        part = raw[low : min(starts, low + SEGMENT) + length - 1]
        hashes = _Hashes(part)
        at = np.arange(len(part) - tuple_bytes + 1)
        names = hashes.of(at, at + tuple_bytes)
        room = np.uint64((1 << 20) - 1)
        best = (names & ~room) | (room - at.astype(np.uint64))  # least hash, then last position
        width, size = length - tuple_bytes + 1, 1
        while size * 2 <= width:
            best, size = np.minimum(best[:-size], best[size:]), size * 2
        if width > size:
            best = np.minimum(best[: size - width], best[width - size :])
        first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        owners = np.diff(np.r_[first, len(best)])
        name = names[(room - (best[first] & room)).astype(np.int64)]
        context = hashes.of(first, first + owners + length - 1) ^ _mixed(owners.astype(np.uint64))
        found.append((name.view(np.int64), context.view(np.int64), first + low, owners))
    return tuple(np.concatenate(x) for x in zip(*found))


def _sample(length: int, tuple_bytes: int):
    def run(batches):
        for pdf in batches:
            for rid, text in zip(pdf["rid"], pdf["text"]):
                name, context, low, owners = sampled(np.frombuffer(text, dtype=np.uint8), length, tuple_bytes)
                if len(name):
                    yield pd.DataFrame({"name": name, "context": context, "rid": rid, "low": low, "n": owners})

    def merged(batches):
        held, rows = [], 0
        for pdf in run(batches):
            held.append(pdf)
            rows += len(pdf)
            if rows >= 1 << 16:
                yield pd.concat(held)
                held, rows = [], 0
        if held:
            yield pd.concat(held)

    return merged


def removed_runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Union of [start, end) intervals as maximal runs, one per row."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    return np.c_[starts[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]]


def _result(doc_id, text: bytes, runs: np.ndarray) -> tuple:
    kept, at = hashlib.sha256(), 0
    for a, b in runs.tolist():
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return doc_id, len(text), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), runs.tolist(), kept.hexdigest()


RESULT = "doc_id {id_type}, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept_sha256 string"
_FINAL = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]


def _settle(length: int):
    """Texts with their marked positions -> results of settled texts, contexts to
    sort, and texts that wait for them (kinds 0, 1, 2)."""

    def run(batches):
        for pdf in batches:
            out = []
            for rid, doc_id, text, marks in zip(pdf["rid"], pdf["doc_id"], pdf["text"], pdf["marks"]):
                marks = [] if marks is None else marks
                low = np.array([m["low"] for m in marks if not m["once"]], dtype=np.int64)
                n = np.array([m["n"] for m in marks if not m["once"]], dtype=np.int64)
                runs = removed_runs(low, low + n + length - 1)
                for m in marks:
                    if m["sort"]:
                        body = text[m["low"] : m["low"] + m["n"] + length - 1]
                        out.append((1, rid, m["name"], m["low"], m["once"], body, None) + (None,) * 6)
                if any(m["once"] for m in marks):
                    out.append((2, rid, None, None, None, text, runs.tolist(), doc_id) + (None,) * 5)
                else:
                    out.append((0, rid, None, None, None, None, None, *_result(doc_id, text, runs)))
            yield pd.DataFrame(out, columns=["kind", "rid", "name", "low", "once", "body", "runs", *_FINAL], dtype=object)

    return run


def suffix_keys(pdf: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per suffix of the contexts: row, start in its context, and a key of its name
    and first ``length`` bytes (which fix its offset to the sampled position)."""
    bodies = pdf["body"].tolist()
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    hashes = _Hashes(np.frombuffer(b"".join(bodies), dtype=np.uint8))
    owners = sizes - length + 1
    row = np.repeat(np.arange(len(bodies)), owners)
    start = np.arange(len(row)) - np.repeat(np.cumsum(owners) - owners, owners)
    name = pdf["name"].to_numpy(dtype=np.int64).view(np.uint64)
    begin = base[row] + start
    key = _mixed(hashes.of(begin, begin + length) ^ name[row])
    return row, start, key


def _as_runs(pdf: pd.DataFrame, row: np.ndarray, start: np.ndarray, length: int) -> pd.DataFrame:
    """Repeated starts of contexts that occur once -> (rid, start, end) runs of bytes."""
    if not len(row):
        return pd.DataFrame({"rid": [], "start": [], "end": []}, dtype=np.int64)
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[new[1:], len(row)] - 1
    low = pdf["low"].to_numpy(dtype=np.int64)[row[new]]
    rid = pdf["rid"].to_numpy(dtype=np.int64)[row[new]]
    return pd.DataFrame({"rid": rid, "start": low + start[new], "end": low + start[last] + length})


def _sort_bucket(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row, start, key = suffix_keys(pdf, length)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]  # neighbours in suffix order
        repeated = np.zeros(len(key), dtype=bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        repeated &= pdf["once"].to_numpy(dtype=bool)[row]
        return _as_runs(pdf, row[repeated], start[repeated], length)

    return run


def _deal_suffixes(length: int):
    def run(batches):
        for pdf in batches:
            for low in range(0, len(pdf), BUCKET):
                part = pdf.iloc[low : low + BUCKET]
                row, start, key = suffix_keys(part, length)
                at = part["low"].to_numpy(dtype=np.int64)[row] + start
                once = part["once"].to_numpy(dtype=bool)[row]
                yield pd.DataFrame({"key": key.view(np.int64), "rid": part["rid"].to_numpy(dtype=np.int64)[row], "start": at, "once": once})

    return run


def _finish(batches):
    for pdf in batches:
        out = []
        for doc_id, text, runs, more in zip(pdf["doc_id"], pdf["body"], pdf["runs"], pdf["more"]):
            spans = [*map(tuple, runs), *((m["start"], m["end"]) for m in ([] if more is None else more))]
            ends = np.array(spans, dtype=np.int64).reshape(-1, 2)
            out.append(_result(doc_id, text, removed_runs(ends[:, 0], ends[:, 1])))
        yield pd.DataFrame(out, columns=_FINAL)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, tuple_bytes: int = TUPLE_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256.

    Texts are UTF-8 bytes (null: empty). Each byte covered by a ``length``-byte
    string that also starts anywhere else, same document included, is removed;
    strings are judged on the input and never cross documents. ``spans`` are
    the maximal removed runs as [start, end) byte offsets, ``kept_sha256`` the
    digest of the remaining bytes. Repeated rows are copies of each other, so
    all they share is removed; texts shorter than ``length`` keep everything;
    an empty table gives no rows; other columns are not read.
    """
    if not 0 < tuple_bytes <= length:
        raise ValueError("tuple_bytes must be between 1 and length")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    texts = numbered(texts, "rid")
    sample = texts.select("rid", "text").mapInPandas(_sample(length, tuple_bytes), "name long, context long, rid long, low int, n int")
    # written sides, so that a hot name or context is a join key that Spark can split
    names = cut_lineage(sample.groupBy("name").count().where("count > 1").select("name"))
    twice = cut_lineage(sample.join(names, "name", "left_semi"))
    contexts = cut_lineage(
        twice.groupBy("name", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "low", "n")).alias("first"))
    )
    flag = F.col("copies") == 1
    known = twice.join(contexts.select("name", "context", "copies"), ["name", "context"])
    known = known.select("rid", F.struct("low", "n", "name", flag.alias("once"), F.lit(False).alias("sort")).alias("mark"))
    # of names with a context that occurs once, one copy of every context is sorted
    sorts = contexts.join(contexts.where(flag).select("name").distinct(), "name", "left_semi")
    sorts = sorts.select("first.rid", F.struct("first.low", "first.n", "name", flag.alias("once"), F.lit(True).alias("sort")).alias("mark"))
    marks = known.unionByName(sorts).groupBy("rid").agg(F.collect_list("mark").alias("marks"))  # a few per byte at most
    id_type = texts.schema["doc_id"].dataType.simpleString()
    final = RESULT.format(id_type=id_type)
    parts = cut_lineage(
        texts.join(marks, "rid", "left").mapInPandas(
            _settle(length), f"kind int, rid long, name long, low int, once boolean, body binary, runs array<array<long>>, {final}"
        )
    )
    ready = parts.where("kind = 1").select("rid", "name", "low", "once", "body")
    large = ready.groupBy("name").count().where(F.col("count") > LARGE_GROUP).select("name")
    small = ready.join(large, "name", "left_anti")
    buckets = max(shuffle_partitions(docs.sparkSession), ready.count() // BUCKET + 1)
    found = (
        small.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(_sort_bucket(length), "rid long, start long, end long")
    )
    dealt = cut_lineage(
        ready.join(large, "name", "left_semi").mapInPandas(_deal_suffixes(length), "key long, rid long, start long, once boolean")
    )
    equal = dealt.groupBy("key").count().where("count > 1").select("key")
    singly = dealt.where("once").join(equal, "key", "left_semi").select("rid", "start", (F.col("start") + length).alias("end"))
    more = found.unionByName(singly).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("more"))
    waiting = parts.where("kind = 2").select("rid", "doc_id", "body", "runs").join(more, "rid", "left").mapInPandas(_finish, final)
    return parts.where("kind = 0").select(*_FINAL).unionByName(waiting)


def op2_substring_dedup(spark, sf_dir):
    out = remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
