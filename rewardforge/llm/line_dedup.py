"""Line dedup: winnowed line hashes find repeated runs of lines; each run is kept
where it first occurs and deleted later on."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, materialize
from .common import by_value, documents, numbered

by_value(__name__)

MIN_LINES = 3  # a repeated run counts from so many lines on,
MIN_WORDS = 50  # or from so many words on
_ROWS = 1 << 15


def fingerprints(lines: list[bytes], min_lines: int, min_words: int) -> dict[int, list[tuple[int, int]]]:
    """Line -> the (start, lines) of the runs it is the fingerprint of.

    Runs are the windows: every ``min_lines`` lines, and every shorter run of at
    least ``min_words`` words. A run selects the least of its lines' hashes (the
    last of equal ones), which depends on the run alone.
    """
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in lines], dtype=np.uint64)
    words = np.r_[0, np.cumsum([len(x.split()) for x in lines])]
    out: dict[int, list[tuple[int, int]]] = {}
    for size in range(1, min(min_lines, len(lines)) + 1):
        starts = np.arange(len(lines) - size + 1)
        if size < min_lines:
            starts = starts[words[starts + size] - words[starts] >= min_words]
        if len(starts):
            view = np.lib.stride_tricks.sliding_window_view(hashes, size)[starts]
            at = starts + size - 1 - view[:, ::-1].argmin(axis=1)
            for line, start in zip(at.tolist(), starts.tolist()):
                out.setdefault(line, []).append((start, size))
    return out


def _select(min_lines: int, min_words: int):
    """Documents -> their fingerprints, each with its runs: start and length in one
    number, and the digest that tells equal runs."""
    columns = ["fp", "no_id", "doc_id", "rid", "marks", "runs"]

    def one(row) -> list[tuple]:
        lines = row.text.split(b"\n")
        out = []
        for line, runs in fingerprints(lines, min_lines, min_words).items():
            fp = xxhash.xxh64_intdigest(lines[line]) - (1 << 63)
            marks = [start * (min_lines + 1) + size for start, size in runs]
            digests = [xxhash.xxh128_digest(b"\n".join(lines[start : start + size])) for start, size in runs]
            out.append((fp, row.no_id, row.doc_id, row.rid, marks, digests))
        return out

    def scan(batches):
        held: list[tuple] = []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                held += one(row)
                while len(held) >= _ROWS:
                    yield pd.DataFrame(held[:_ROWS], columns=columns)
                    held = held[_ROWS:]
        if held:
            yield pd.DataFrame(held, columns=columns)

    return scan


def _delete(min_lines: int):
    def scan(batches):
        for pdf in batches:
            out = []
            for doc_id, text, later in zip(pdf["doc_id"], pdf["text"], pdf["later"]):
                lines = text.split(b"\n")
                drop = np.zeros(len(lines) + 1, dtype=np.int64)
                if later is not None:
                    start, size = np.divmod(np.asarray(later, dtype=np.int64), min_lines + 1)
                    np.add.at(drop, start, 1)
                    np.add.at(drop, start + size, -1)
                gone = np.cumsum(drop[:-1]) > 0
                kept = b"\n".join(x for x, g in zip(lines, gone) if not g)
                n_runs = int((gone & ~np.r_[False, gone[:-1]]).sum())
                out.append((doc_id, len(lines), int(gone.sum()), n_runs, kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_lines", "n_removed", "n_runs", "kept_text", "kept_sha256"])

    return scan


def remove_repeated_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, n_runs, kept_text, kept_sha256.

    Lines end at ``\\n``. A run of consecutive lines counts when it has at least
    ``min_lines`` lines or ``min_words`` words (separated by ASCII white space).
    A line goes when a run that counts covers it and also starts earlier in the
    corpus (by id, then line number; same document included, overlaps too).

    Every run that counts and has up to ``min_lines`` lines selects its least
    line hash as fingerprint, so equal runs always meet at one. Fingerprints
    are computed once and written. Around one that occurs twice the match is
    extended both ways, one line at a time, to each run it stands for; a run
    meets its first occurrence by an equi-join on its lines' digest (128 bits),
    and the covered lines of a document join to its maximal deleted runs
    (``n_runs``). Longer runs are covered by their parts. No pairs are formed,
    and the sides of both joins are written, so that a line or run held by a
    third of all rows is split.

    A null text is one empty line. Null ids come last, equal ids in input
    order, so of repeated rows the first stays. Texts shorter than ``min_lines``
    lines and ``min_words`` words keep every line. A very long text is one row:
    a task holds its lines and one number per repeated run in it. An empty table
    gives no rows; other columns are not read.
    """
    if min_lines < 1 or min_words < 1:
        raise ValueError("min_lines and min_words must be positive")
    texts = docs.select(
        F.col(id_col).isNull().alias("no_id"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )
    texts = numbered(texts, "rid")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    schema = f"fp long, no_id boolean, doc_id {id_type}, rid long, marks array<long>, runs array<binary>"
    found = materialize(texts.mapInPandas(_select(min_lines, min_words), schema), "line-fingerprints")
    twice = cut_lineage(found.groupBy("fp").count().where("count > 1").select("fp"))
    extended = found.join(twice, "fp", "left_semi").select("no_id", "doc_id", "rid", F.explode(F.arrays_zip("marks", "runs")).alias("r"))
    place = F.struct("no_id", "doc_id", "rid", F.col("r.marks").alias("mark"))
    runs = cut_lineage(extended.select(F.col("r.runs").alias("run"), place.alias("place")))
    first = cut_lineage(runs.groupBy("run").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    later = runs.join(first, "run").where(F.col("place") != F.col("first"))
    later = later.groupBy(F.col("place.rid").alias("rid")).agg(F.collect_list("place.mark").alias("later"))
    return (
        texts.join(later, "rid", "left")
        .select("doc_id", "text", "later")
        .mapInPandas(
            _delete(min_lines),
            f"doc_id {id_type}, n_lines long, n_removed long, n_runs long, kept_text string, kept_sha256 string",
        )
    )


def op10_line_dedup(spark, sf_dir):
    out = remove_repeated_lines(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256")


ORACLE = r"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents),
r as (
  select doc_id, i, n, a[i : i + n - 1] as g
  from (select doc_id, a, n, unnest(range(1, len(a) - n + 2)) as i from l, (values (1), (2), (3)) as s(n) where len(a) >= n)
), c as (
  select doc_id, i, n, array_to_string(g, chr(10)) as g from r
  where n = 3 or len(regexp_extract_all(array_to_string(g, chr(10)), '[^\x20\x09-\x0D]+')) >= 50
), w as (select doc_id, i, n, row_number() over (partition by n, g order by doc_id, i) > 1 as later from c),
gone as (select distinct doc_id, unnest(range(i, i + n)) as p from w where later),
e as (
  select doc_id, p, a[p] as t, g.p2 is not null as dropped
  from (select doc_id, a, unnest(range(1, len(a) + 1)) as p from l) x
  left join (select doc_id as d2, p as p2 from gone) g on g.d2 = x.doc_id and g.p2 = x.p
), f as (select *, dropped and not coalesce(lag(dropped) over (partition by doc_id order by p), false) as opens from e)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_removed, count(*) filter (where opens) as n_runs,
  sha256(coalesce(string_agg(t, chr(10) order by p) filter (where not dropped), '')) as kept_sha256
from f group by doc_id
"""
