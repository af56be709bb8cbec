"""Language ID: script ranges narrow the candidates, Viterbi over per-word
scores with a switching penalty labels spans."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, documents, fold

by_value(__name__)

FOLDS, HELD_OUT = 5, 0
TRAIN_PER_LANG = 5000  # bound of the training sample: expected documents per language
SWITCH_COST = 12.0  # nats
CELLS = 1 << 16  # hashed letter trigrams
SCRIPT_SHARE = 1e-3  # a language is a candidate for scripts with this share of its letters
PIECE = 1 << 20  # characters scored at once
_FAR = -30.0

# First code points of script blocks, and the script that holds from there.
SCRIPT_STARTS = (
    0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0980, 0x0B80, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00,
    0x1F00, 0x2000, 0x3040, 0x30A0, 0x3400, 0xA000, 0xAC00, 0xD800, 0xF900, 0xFB00, 0xFB13, 0xFB1D, 0xFB50, 0xFE00, 0xFE70, 0xFF00, 0xFF21, 0xFF5B,
    0xFF66, 0xFFA0, 0xFFE0, 0x20000, 0x323B0,
)
SCRIPT_NAMES = (
    "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "bengali", "tamil", "thai", "lao", "georgian", "hangul", "ethiopic", "latin",
    "greek", "other", "kana", "kana", "han", "other", "hangul", "other", "han", "latin", "armenian", "hebrew", "arabic", "other", "arabic", "other", "latin", "other",
    "kana", "hangul", "other", "han", "other",
)
_NAMES = sorted(set(SCRIPT_NAMES) - {"latin"})
_SCRIPT_ID = np.array([0 if s == "latin" else 1 + _NAMES.index(s) for s in SCRIPT_NAMES])
N_SCRIPTS = 1 + len(_NAMES)

_letters: list[np.ndarray] = []


def _is_letter(cp: np.ndarray) -> np.ndarray:
    """Unicode letters by code point."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0][cp]


def _trigrams(cp: np.ndarray, letter: np.ndarray):
    """Hashed trigram around each letter (0 beyond the word); word number and script per letter."""
    own = np.flatnonzero(letter)
    before = np.where(letter[own - 1], cp[own - 1], 0)
    after = np.where(letter[own + 1], cp[own + 1], 0)
    with np.errstate(over="ignore"):
        h = before * np.uint32(0x9E3779B1) ^ (cp[own] * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F)) ^ after * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    cells = (h >> np.uint32(16)).astype(np.int64)
    first = np.flatnonzero(before == 0) if len(own) else own
    scripts = _SCRIPT_ID[np.searchsorted(SCRIPT_STARTS, cp[own], side="right") - 1]
    return own, cells, first, scripts


def _code_points(text: str) -> np.ndarray:
    """Lower-cased code points with a gap at either end; offsets stay those of the text."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals lower to two characters: lower them one by one
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return np.r_[np.uint32(0), np.frombuffer(low.encode("utf-32-le", "replace"), dtype="<u4"), np.uint32(0)]


def _pieces(text: str):
    """(offset, piece) of at most about PIECE characters, cut at blanks where there are any."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            blank = text.rfind(" ", at, end)
            end = blank if blank > at else end
        yield at, text[at:end]
        at = end


class LanguageModel:
    """Trigram log-probabilities (cells x languages) and script candidates: bounded by the languages."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.1
        self.logp = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        self.candidates = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))

    def words(self, cp: np.ndarray):
        """Per word of the code points: scores per language (0 is best), letters, start, end."""
        letter = _is_letter(cp)
        own, cells, first, scripts = _trigrams(cp, letter)
        if not len(own):
            return np.zeros((0, len(self.langs)), dtype=np.float32), own, own, own
        scores = np.add.reduceat(self.logp[cells], first, axis=0)
        script = np.maximum.reduceat(scripts, first)
        allowed = self.candidates[script]
        open_script = ~allowed.any(axis=1)
        scores[~allowed & ~open_script[:, None]] += _FAR
        scores[open_script] = 0.0  # no language learned uses the script: no evidence
        letters = np.diff(np.r_[first, len(own)])
        starts = own[first]
        ends = own[np.r_[first[1:], len(own)] - 1] + 1
        return scores - scores.max(axis=1, keepdims=True), letters, starts - 1, ends - 1


def viterbi(scores: list[np.ndarray], cost: float) -> list[np.ndarray]:
    """Best language per word for many documents at once, longest first.

    Step t handles word t of every document that has one; switching between
    any two languages costs ``cost``.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(scores)
    if not len(sizes) or sizes[0] == 0:
        return out
    flat = np.concatenate([scores[i] for i in order])
    offset = np.r_[0, np.cumsum(sizes)[:-1]]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # documents longer than t
    stay = np.zeros(flat.shape, dtype=bool)
    best = np.zeros(len(flat), dtype=np.int32)  # the best language before word t
    value = flat[offset[: active[0]]].copy()
    for t in range(1, sizes[0]):
        k = active[t]
        at = offset[:k] + t
        v = value[:k]
        top = v.argmax(axis=1)
        jump = v[np.arange(k), top][:, None] - cost
        keep = v >= jump
        stay[at], best[at] = keep, top
        value[:k] = flat[at] + np.where(keep, v, jump)
    state = value.argmax(axis=1)
    paths = np.zeros(len(flat), dtype=np.int32)
    for t in range(sizes[0] - 1, -1, -1):
        k = active[t]
        at = offset[:k] + t
        paths[at] = state[:k]
        if t:
            state[:k] = np.where(stay[at, state[:k]], state[:k], best[at])
    for n, i in enumerate(order):
        out[i] = paths[offset[n] : offset[n] + sizes[n]]
    return out


def _label(model: LanguageModel, texts: list[str | None], cost: float) -> list[tuple]:
    """(lang, score, spans) per text, in runs of texts of about PIECE characters, like lengths together."""
    out: list[tuple] = [("und", 0.0, [])] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
    at = 0
    while at < len(order):
        run, held = [], 0
        while at < len(order) and (not run or held < PIECE):
            run.append(order[at])
            held += len(texts[order[at]] or "")
            at += 1
        parts = []
        for i in run:
            found = [(off, model.words(_code_points(p))) for off, p in _pieces(texts[i] or "")]
            parts.append([
                np.concatenate([w[0] for _, w in found] or [np.zeros((0, len(model.langs)), dtype=np.float32)]),
                *(np.concatenate([w[c] + (off if c > 1 else 0) for off, w in found] or [np.zeros(0, dtype=np.int64)]) for c in (1, 2, 3)),
            ])
        for i, part, path in zip(run, parts, viterbi([p[0] for p in parts], cost)):
            if len(path):
                share = np.bincount(path, weights=part[1], minlength=len(model.langs)) / part[1].sum()
                turns = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
                ends = np.r_[turns[1:], len(path)] - 1
                spans = [{"lang": model.langs[path[a]], "start": int(part[2][a]), "end": int(part[3][b])} for a, b in zip(turns, ends)]
                out[i] = (model.langs[int(share.argmax())], float(share.max()), spans)
    return out


def _count(batches):
    """One task's trigram and script counts per language, packed."""
    counts: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            own = counts.setdefault(lang, np.zeros(CELLS + N_SCRIPTS, dtype=np.int64))
            for _, piece in _pieces(text or ""):
                cp = _code_points(piece)
                _, cells, _, scripts = _trigrams(cp, _is_letter(cp))
                own += np.r_[np.bincount(cells, minlength=CELLS), np.bincount(scripts, minlength=N_SCRIPTS)]
    for lang, own in counts.items():
        yield pd.DataFrame({"lang": [lang], "counts": [zlib.compress(own.tobytes(), 1)]})


def _sum_counts(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = 0
    for pdf in batches:
        for packed in pdf["counts"]:
            total = total + np.frombuffer(zlib.decompress(packed), dtype=np.int64)
    yield pd.DataFrame({"lang": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def fit_languages(rows: DataFrame, per_lang: int = TRAIN_PER_LANG) -> LanguageModel | None:
    """Learn from rows (doc_id, text, lang), lang not null.

    Of a language with more rows than ``per_lang``, the rows whose hashed id
    falls under per_lang / rows are read (about ``per_lang``). One packed count
    vector per language reaches the driver.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return None
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    cut = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, per_lang / n) * 1_000_000))])
    sample = rows.where(spot < cut[F.col("lang")]).select("lang", "text")
    made = sample.mapInPandas(_count, "lang string, counts binary")
    made = made.groupBy("lang").applyInPandas(_sum_counts, "lang string, counts binary").collect()
    if not made:
        return None
    made = {r["lang"]: np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64) for r in made}
    langs = sorted(made)
    table = np.stack([made[x] for x in langs], axis=1)
    return LanguageModel(langs, table[:CELLS], table[CELLS:])


def _predict(model, cost: float):
    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            found = [("und", 0.0, [])] * len(texts) if model.value is None else _label(model.value, texts, cost)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "spans": [f[2] for f in found]})

    return run


def identify_languages(
    docs: DataFrame, cost: float = SWITCH_COST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, spans.

    Words are runs of letters; a word's candidates are the languages that use
    its script, scored by letter trigrams. Viterbi with ``cost`` per switch
    labels each word; ``spans`` are the runs of one language (character offsets
    [start, end)). ``lang_pred`` has most letters (a tie: the smaller name),
    ``score`` is its share of the letters. Texts that are null or without a
    letter are ``und`` with score 0, as is everything when no row has a lang to
    learn from. Learned from rows with crc32(doc_id as text) mod 5 <> 0; a null
    id neither trains nor is held out. Repeated rows are labelled alike; an
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    learn = rows.where((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull())
    model = spark.sparkContext.broadcast(fit_languages(learn))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", "text").mapInPandas(
        _predict(model, cost),
        f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang:string,start:long,end:long>>",
    )
    return found.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans"
    )


def op6_language(spark, sf_dir):
    found = identify_languages(documents(spark, sf_dir, "doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")
