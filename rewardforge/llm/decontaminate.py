"""Benchmark decontamination with one Aho-Corasick automaton over item windows."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import by_value, documents

by_value(__name__)

WINDOW_WORDS = 10
CHUNK_BYTES = 32 << 20  # benchmark text that one automaton holds
# Bytes of words: digits, letters (A-Z lower-cased) and everything above ASCII.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
FOUND = "doc_id {id_type}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def plain_bytes(text: str | None) -> bytes:
    """The text's UTF-8 bytes, lower-cased, anything that is no word as blanks."""
    return (text or "").encode("utf-8", "replace").translate(_PLAIN)


def windows(text: str | None, size: int) -> list[tuple[int, str]]:
    """(words, pattern) of each window of an item; latin-1 keeps one character per byte."""
    words = plain_bytes(text).split()
    if not words:
        return []
    n = min(size, len(words))
    return [(n, (b" %s " % b" ".join(words[i : i + n])).decode("latin-1")) for i in range(len(words) - n + 1)]


def _automaton(items: list[tuple[str, str]], size: int):
    owners: dict[str, tuple[int, set]] = {}
    for name, text in items:
        for n, pattern in windows(text, size):
            owners.setdefault(pattern, (n, set()))[1].add(name)
    if not owners:
        return None
    built = ahocorasick.Automaton()
    for pattern, (n, names) in owners.items():
        built.add_word(pattern, (n, names))
    built.make_automaton()
    return built


def _scan(chunks: list, size: int):
    """Rows of (doc_id, text) -> what each chunk's automaton finds in them."""

    def run(batches):
        built = [_automaton(chunks[0].value, size)] if len(chunks) == 1 else None
        for pdf in batches:
            plain = [plain_bytes(t) for t in pdf["text"]]
            n_words, hits, found = [len(b.split()) for b in plain], [None] * len(plain), [set() for _ in plain]
            for c in range(len(chunks)):
                own = built[c] if built else _automaton(chunks[c].value, size)
                if own is None:
                    continue
                for i, b in enumerate(plain):
                    body = f" {b' '.join(b.split()).decode('latin-1')} "
                    blanks = None
                    for end, (n, names) in own.iter(body):
                        if blanks is None:  # word number by place of the blank after it
                            blanks = np.cumsum(np.frombuffer(body.encode("latin-1"), dtype=np.uint8) == 32)
                            hits[i] = np.zeros(n_words[i], dtype=bool) if hits[i] is None else hits[i]
                        last = blanks[end] - 1
                        hits[i][last - n : last] = True
                        found[i] |= names
            spans = [[] if h is None else _spans(b, h) for b, h in zip(plain, hits)]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "n_words": n_words,
                "n_hit": [0 if h is None else int(h.sum()) for h in hits],
                "items": [sorted(f) for f in found],
                "spans": spans,
            })

    return run


def _spans(plain: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character offsets [start, end) of the original text."""
    raw = np.frombuffer(plain, dtype=np.uint8)
    inside = np.r_[False, raw != 32, False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    run = np.r_[False, hit, False]
    turns = np.flatnonzero(run[1:] != run[:-1])
    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # characters before each byte
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in zip(turns[0::2], turns[1::2])]


def _broadcast_chunks(items: DataFrame, chunk_bytes: int) -> list:
    """The benchmark as broadcast lists of (id, text), each of about ``chunk_bytes`` at most."""
    sc = items.sparkSession.sparkContext
    chunks, own, held = [], [], 0
    wanted = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    for name, text in wanted.toLocalIterator():
        own.append((name, text))
        held += len(text.encode("utf-8", "replace"))
        if held >= chunk_bytes:
            chunks.append(sc.broadcast(own))
            own, held = [], 0
    return [*chunks, sc.broadcast(own)] if own or not chunks else chunks


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns (no shuffle)."""
    chunks = _broadcast_chunks(items, chunk_bytes)
    scan = _scan(chunks, window)

    def hit(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in scan(pd.DataFrame({"doc_id": range(len(t)), "text": t}) for t in texts):
            yield found["n_hit"] > 0

    return docs.where(~F.pandas_udf(hit, "boolean")("text"))


def find_benchmark(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW_WORDS,
    chunk_bytes: int = CHUNK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, items, spans.

    ``items`` (item_id, text) become windows of ``window`` consecutive words (a
    shorter item is one window, an empty or null one none); a document word
    inside an occurrence is hit. ``items`` lists the sorted ids found (a null
    id as ''), ``spans`` the hit runs as character offsets of the original
    text. Documents are scanned where they lie, in one pass and without a
    shuffle. The benchmark is read in chunks of at most ``chunk_bytes``; each
    has an automaton, and with more than one chunk only one automaton is held
    at a time. Null texts have no words; repeated rows are each scanned; with no
    items nothing is hit; an empty table gives no rows.
    """
    chunks = _broadcast_chunks(items, chunk_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_scan(chunks, window), FOUND.format(id_type=rows.schema["doc_id"].dataType.simpleString()))


def op7_decontaminate(spark, sf_dir):
    found = find_benchmark(documents(spark, sf_dir, "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), lens as (select distinct least(10, len(w)) as n from b where len(w) > 0),
bw as (
  select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as g
  from (select item, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)
), dw as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)
), hit as (select doc_id, dw.n, i, item from dw join bw on dw.g = bw.g and dw.n = bw.n),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, n, i from hit)) group by 1),
its as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as s from hit group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join its using (doc_id)
"""
