"""Operators on odd rows and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from rewardforge.llm import (
    decontaminate,
    exact_dedup,
    language,
    line_dedup,
    mixing,
    quality,
    queries,
    sharding,
    simhash,
    substring_dedup,
    url_filter,
)

SF_SMALL = "/root/testdata/sf0.001"
N_ODD = 15
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def key(doc_id):
    return (doc_id is None, doc_id or 0)


# ---- 1 quality
def test_quality_learns_and_odd_rows(spark, odd, none):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["Der", "hund", "geht", "nach", "hause."]) for _ in range(40)) if i % 3 else "!! ## " * 20 for i in range(400)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    out = quality.score_quality(docs, labels).collect()
    held = [r for r in out if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 > 0) for r in held]) > 0.98
    assert len(quality.score_quality(odd, labels).collect()) == N_ODD
    assert quality.score_quality(none, labels).count() == 0
    unknown = quality.score_quality(odd, labels.limit(0)).collect()
    assert {r["score"] for r in unknown} == {1.0} and quality.keep_good(odd, labels.limit(0)).columns == odd.columns


def test_isotonic_is_nearest_monotone():
    w = np.ones(5)
    assert quality.isotonic(w, np.array([0.0, 1.0, 0.0, 1.0, 1.0])).tolist() == [0.0, 0.5, 0.5, 1.0, 1.0]


# ---- 2 repeated byte strings
def brute_substrings(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        mask = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                mask[s : s + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mask) if not m)
        runs = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        out.append((len(b), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("large", [4096, 1])
def test_substrings_against_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(substring_dedup, "LARGE_GROUP", large)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    shared = [word(rng.randint(15, 60)) for _ in range(6)]
    texts = [None, "", "a", "ab" * 40, "ab" * 40 + "c"]
    texts += ["".join(rng.choice([word(rng.randint(1, 30)), rng.choice(shared), rng.choice(shared)]) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    out = by_id(substring_dedup.remove_repeats(docs_of(spark, texts), length=20, tuple_bytes=8))
    got = [tuple(out[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))]
    assert got == brute_substrings(texts, 20)


def test_substrings_odd_rows(odd, none):
    out = substring_dedup.remove_repeats(odd).collect()
    assert len(out) == N_ODD and substring_dedup.remove_repeats(none).count() == 0
    got = {r["doc_id"]: r for r in out}
    assert got[6]["n_removed"] == got[7]["n_removed"] > 300 and got[11]["n_removed"] == got[11]["n_bytes"] and got[3]["n_bytes"] == 0


# ---- 3 exact dedup
@pytest.mark.parametrize("filter_bytes", [1 << 20, 16])
def test_exact_groups(odd, none, filter_bytes):
    out = exact_dedup.exact_groups(odd, filter_bytes=filter_bytes).collect()
    assert len(out) == N_ODD
    sizes = Counter(r["text_sha256"] for r in out)
    groups = defaultdict(list)
    for r in out:
        assert r["group_size"] == sizes[r["text_sha256"]]
        groups[r["text_sha256"]].append(r)
    for rows in groups.values():
        assert sum(r["kept"] for r in rows) == 1
        assert {r["keep_id"] for r in rows} == {min((r["doc_id"] for r in rows), key=key)}
    assert groups[hashlib.sha256(b"Alpha beta gamma delta epsilon zeta").hexdigest()][0]["keep_id"] == 1
    assert groups[hashlib.sha256(b"").hexdigest()][0]["group_size"] == 3
    assert exact_dedup.exact_groups(none).count() == 0


def test_packed_filter_counts_hits():
    rng = np.random.default_rng(3)
    cells, batches = 1003, [pd.DataFrame({"digest": [rng.bytes(32) for _ in range(n)]}) for n in (0, 40, 1, 90)]
    hits = Counter(c for b in batches if len(b) for row in exact_dedup._cells(exact_dedup._words(b["digest"]), cells) for c in set(row.tolist()))
    (row,) = [r for out in exact_dedup._two_bits(cells)(iter(batches)) for r in out.itertuples()]
    once, twice = np.unpackbits(np.frombuffer(zlib.decompress(row.bits), dtype=np.uint8).reshape(2, -1), axis=1)[:, :cells]
    assert set(np.flatnonzero(once)) == set(hits) and set(np.flatnonzero(twice)) == {c for c, n in hits.items() if n > 1}


# ---- 4 SimHash
def test_trie_pairs_against_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False))) for x in base for _ in range(6)]
    leaves = np.unique(np.array([*base, *flips], dtype=np.uint64))
    want = {(i, j) for i in range(len(leaves)) for j in range(i + 1, len(leaves)) if int(leaves[i] ^ leaves[j]).bit_count() <= 4}
    got = [(int(x), int(y)) for i, j in simhash.trie_pairs(leaves, None, 0, 0, 4) for x, y in zip(i, j)]
    assert want and set(got) == want and len(got) == len(want)


def test_near_duplicates_against_brute_force(spark, odd, none):
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randint(0, 400)}" for _ in range(300)]
        for _ in range(4):
            texts.append(" ".join(words))
            words[rng.randrange(300)] = "Ω"
    texts += [None, "", "one", "ONE", "two words"]
    prints = [simhash.fingerprint(t) for t in texts]
    parent = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    out = by_id(simhash.near_duplicates(docs_of(spark, texts)))
    assert [out[i]["component_id"] for i in range(len(texts))] == parent and len(set(parent)) < len(texts) - 20
    assert all(out[i]["fp"] % (1 << 64) == prints[i] for i in out) and prints[-5] == 0
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == N_ODD and simhash.near_duplicates(none).count() == 0
    groups = Counter(r["component_id"] for r in rows)
    first = simhash.keep_first(odd)
    assert first.columns == odd.columns and first.count() == len(groups)


def test_large_families_are_joined_deeper_down(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    family = {base ^ sum(1 << b for b in rng.sample(range(11), rng.randint(0, 8))) for _ in range(900)}
    spread = {base ^ sum(1 << b for b in rng.sample(range(64), 4)) for _ in range(150)}
    fps = sorted(family | spread | {x ^ 1 << rng.randrange(64) for x in spread})
    assert len(family) > 512
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(3)
    links = simhash.near_links(df, node_leaves=256).cache()
    pairs = {(r["x"] ^ r["y"]) & (1 << 64) - 1 for r in links.collect()}
    assert pairs and all(0 < p.bit_count() <= 2 for p in pairs)
    got = {r["node"]: r["root"] for r in simhash.connected(links).collect()}
    classes = {}
    for f in fps:
        near = {id(c): c for o, c in classes.items() if (f ^ o).bit_count() <= 2}
        joined = {f}.union(*near.values())
        classes |= dict.fromkeys(joined, joined)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    assert {f: got.get(signed[f], signed[f]) for f in fps} == {f: min(signed[o] for o in classes[f]) for f in fps}


def test_connected_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "x long, y long")
    got = {r["node"]: r["root"] for r in simhash.connected(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# ---- 5 mixing
def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 5, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 99).tolist()) == list(range(n))


def water_filling(sizes, weights, cap):
    total, targets, left = sum(sizes), {}, set(range(len(sizes)))
    while left:
        share = (total - sum(targets.values())) / sum(weights[i] for i in left)
        over = [i for i in left if share * weights[i] > cap * sizes[i]]
        targets |= {i: cap * sizes[i] for i in over} if over else {i: share * weights[i] for i in left}
        left -= set(over) if over else left
    return [targets[i] for i in range(len(sizes))]


def test_mix_meets_targets(spark, odd, none):
    rng = random.Random(5)
    names = ["a", "b", "c", "d", None]
    rows = [(i, "w " * rng.choice([0, 1, 3, 50, 400]), rng.choices(names, [1, 2, 9, 30, 3])[0]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_documents(docs, block=16).collect()
    assert len(out) == 300 and sorted(map(str, out)) == sorted(map(str, mixing.mix_documents(docs, block=16).collect()))
    sizes = [sum(len(t.split()) for _, t, s in rows if s == n) for n in names]
    want = water_filling(sizes, [5, 2, 1, 5, 2], 3)
    for n, size, target in zip(names, sizes, want):
        own = [r for r in out if r["source"] == n]
        assert all(r["source_size"] == size and abs(r["target"] - target) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert sum(r["taken"] for r in own) == round(target)
    assert mixing.mix_documents(odd).count() == N_ODD and mixing.mix_documents(none).count() == 0
    taken = {r["doc_id"]: r["taken"] for r in out}
    texts = mixing.mixed_texts(docs, block=16).collect()
    assert {r["doc_id"]: len(r["text"].split()) for r in texts} == {i: n for i, n in taken.items() if n}
    assert mixing.mixed_texts(odd).columns == odd.columns and mixing.mixed_texts(none).count() == 0


# ---- 6 language
def test_languages_and_spans(spark, odd, none):
    vocab = {"xx": ["banala", "nabana", "lanaba"], "yy": ["kritch", "schtrk", "trisch"], "ru": ["привет", "мирный", "время"]}
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(30)), k) for i, k in enumerate(sorted(vocab) * 40)]
    mixed = (10_000, "banala lanaba " * 10 + "kritch schtrk " * 20 + "123", "yy")
    docs = spark.createDataFrame([*rows, mixed, (10_001, "123 !!", "xx"), (10_002, None, "xx")], "doc_id long, text string, lang string")
    out = by_id(language.identify_languages(docs))
    assert all(out[i]["lang_pred"] == k for i, _, k in rows) and any(r["held_out"] for r in out.values())
    assert [s["lang"] for s in out[10_000]["spans"]] == ["xx", "yy"] and out[10_000]["lang_pred"] == "yy"
    first = out[10_000]["spans"][0]
    assert mixed[1][first["start"] : first["end"]].split() == ["banala", "lanaba"] * 10
    assert {out[10_001]["lang_pred"], out[10_002]["lang_pred"]} == {"und"}
    assert len(language.identify_languages(odd).collect()) == N_ODD and language.identify_languages(none).count() == 0


def test_viterbi_against_one_by_one():
    rng = np.random.default_rng(7)
    scores = [rng.normal(0, 5, (n, 3)).astype(np.float32) for n in (0, 1, 7, 40, 40)]
    for s, path in zip(scores, language.viterbi(scores, 4.0)):
        best = [(0.0, [])] if not len(s) else [(float(x), [i]) for i, x in enumerate(s[0])]
        for row in s[1:]:
            best = [max(((v + float(x) - 4.0 * (p[-1] != i), [*p, i]) for v, p in best), key=lambda y: y[0]) for i, x in enumerate(row)]
        assert path.tolist() == max(best, key=lambda y: y[0])[1]


# ---- 7 decontamination
@pytest.mark.parametrize("chunk", [1 << 20, 1])
def test_benchmark_words(spark, odd, none, chunk):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(12)] + ["ß", "Ünï"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [say(n) for n in (3, 12, 14, 1, 0, 25)]
    texts = [" ".join([*say(9), *items[k % 6][:11], *say(5)]) + "!" for k in range(40)] + [None, "", "..."]
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(items)] + [(77, None)], "item_id long, text string")
    windows = [[w[i : i + 10] for i in range(max(1, len(w) - 9))] if w else [] for w in items]
    out = by_id(decontaminate.find_benchmark(docs_of(spark, texts), bench, chunk_bytes=chunk))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        hit, found = set(), set()
        for n, own in enumerate(windows):
            for w in own:
                w = [x.translate(lower) for x in w]
                for p in range(len(words) - len(w) + 1):
                    if words[p : p + len(w)] == w:
                        hit |= set(range(p, p + len(w)))
                        found.add(str(n))
        r = out[i]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(words), len(hit), sorted(found))
        spans = " ".join(t[s["start"] : s["end"]].translate(lower) for s in r["spans"]) if t else ""
        assert re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", spans) == [w for p, w in enumerate(words) if p in hit]
    assert decontaminate.find_benchmark(odd, bench).count() == N_ODD and decontaminate.find_benchmark(none, bench).count() == 0
    assert decontaminate.keep_clean(odd, bench.limit(0)).count() == N_ODD


# ---- 8 URLs
def test_urls(spark):
    urls = {
        "http://Example.NET/en/x?y": "example.net/en/", "http://a.b.example.net/de/": "net/", "https://net/#": "net/", "https://net": None,
        "x://fr.example.com/de/a": "example.com/de/", "http://o.org/fr": None, "http://o.org/fr/": "org/fr/", "ftp://notnet.nets/": None,
        "no scheme.net/": None, "": None, "a://b.org/x://net/": None,
    }
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(None, None, "x"), (1, "http://q.net/", "x"), (1, "http://q.net/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = url_filter.judge_urls(pages, url_filter.rules_table(spark)).collect()
    got = {r["page_id"]: r for r in out if r["host"] != "q.net"}
    assert len(out) == len(rows) and [got[i]["rule"] for i in range(len(urls))] == list(urls.values())
    assert got[0]["verdict"] == "allow" and got[1]["verdict"] == "block" and got[None]["host"] == got[None]["path"] == ""
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_table(spark)).count() == 0
    nothing = url_filter.judge_urls(pages, url_filter.rules_table(spark).limit(0)).collect()
    assert {r["verdict"] for r in nothing} == {"allow"}


# ---- 9 shards
def test_shards(spark, odd, none):
    rng = random.Random(9)
    texts = [None if i % 50 == 0 else "é" * rng.randint(0, 300) for i in range(500)]
    out = sorted(sharding.assign_shards(docs_of(spark, texts)).collect(), key=lambda r: r["doc_id"])
    sizes = [len((t or "").encode()) + 1 for t in texts]
    assert [r["size"] for r in out] == sizes and [r["text_crc32"] for r in out] == [zlib.crc32((t or "").encode()) for t in texts]
    total, before, seen = sum(sizes), 0, Counter()
    for r, size in zip(out, sizes):
        assert r["shard"] == before * 16 // total and r["slot"] == seen[r["shard"]]
        seen[r["shard"]] += 1
        before += size
    rows = sharding.assign_shards(odd).collect()
    assert len(rows) == N_ODD and len({(r["shard"], r["slot"]) for r in rows}) == N_ODD
    assert sharding.assign_shards(none).count() == 0


# ---- 10 lines
def lines_that_go(texts, min_lines, min_words):
    """Every run of lines that counts, of any length, against all that start earlier."""
    texts = [(t or "").split("\n") for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for i, lines in enumerate(texts):
        for p in range(len(lines)):
            for end in range(p + 1, len(lines) + 1):
                run = tuple(lines[p:end])
                if len(run) >= min_lines or sum(len(WORD.findall(x)) for x in run) >= min_words:
                    gone[i] |= set(range(p, end)) if run in seen else set()
                    seen.add(run)
    return gone


@pytest.mark.parametrize(("min_lines", "min_words"), [(3, 50), (3, 5), (1, 9), (5, 4)])
def test_repeated_lines_against_brute_force(spark, min_lines, min_words):
    rng = random.Random(10)
    texts = [None, ""] + ["\n".join(rng.choice(["a", "b", "c c", "d d d", "", "f f f f"]) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    out = by_id(line_dedup.remove_repeated_lines(docs_of(spark, texts), min_lines, min_words))
    for i, (t, gone) in enumerate(zip(texts, lines_that_go(texts, min_lines, min_words))):
        lines = (t or "").split("\n")
        kept = "\n".join(x for p, x in enumerate(lines) if p not in gone)
        assert (out[i]["n_lines"], out[i]["n_removed"], out[i]["kept_text"]) == (len(lines), len(gone), kept)
        assert out[i]["n_runs"] == sum(p - 1 not in gone for p in gone)


def test_repeated_lines_of_odd_rows(spark, odd, none):
    rows = line_dedup.remove_repeated_lines(odd).collect()
    assert len(rows) == N_ODD and sum(r["n_removed"] for r in rows) >= 7
    assert line_dedup.remove_repeated_lines(none).count() == 0


def test_one_and_two_long_lines_go_where_they_come_again(spark):
    long, half, rest = (" ".join(f"{w}{i}" for i in range(n)) for w, n in (("a", 50), ("b", 30), ("c", 30)))
    short = "only nine and forty " * 12 + "words"
    texts = [long, f"x\n{long}\ny", f"{half}\n{rest}", f"x\n{half}\n{rest}\ny", half, short, short, long]
    out = by_id(line_dedup.remove_repeated_lines(docs_of(spark, texts)))
    assert [out[i]["kept_text"] for i in range(8)] == [long, "x\ny", f"{half}\n{rest}", "x\ny", half, short, short, ""]


def test_a_line_in_every_document_and_a_very_long_text(spark):
    common = " ".join(f"w{i}" for i in range(60))
    many = "\n".join(f"row {i}" for i in range(200_000))
    texts = [f"own {i}\n{common}\nend {i}" for i in range(600)] + [many, f"head\n{many}", "one line " * 400_000]
    out = by_id(line_dedup.remove_repeated_lines(docs_of(spark, texts)))
    assert out[0]["n_removed"] == 0 and all(out[i]["kept_text"] == f"own {i}\nend {i}" for i in range(1, 600))
    assert [out[i]["n_removed"] for i in (600, 601, 602)] == [0, 200_000, 0] and out[601]["kept_text"] == "head"


# ---- queries and pipeline
OTHER_ROWS = {"op11_whitening", "op13_collocations"}  # by contract not one row per row of a table


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - OTHER_ROWS))
def test_query_gives_every_row(spark, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    table = "pages" if name.startswith("op8") else "documents"
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count()


def test_whitening_gives_every_vector_and_component(spark):
    vectors = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").toPandas()
    column = next(c for c in vectors.columns if c != "vec_id" and isinstance(vectors[c].iloc[0], (list, np.ndarray)))
    good = [v for v in vectors[column] if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = queries.QUERIES["op11_whitening"](spark, SF_SMALL)
    assert out.count() == len(good) * min(32, len(good[0])) and out.select("vec_id", "component").distinct().count() == out.count()


def test_collocations_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF_SMALL}/documents.parquet')")
    out = queries.QUERIES["op13_collocations"](spark, SF_SMALL)
    columns = ", ".join(out.columns)
    want = con.execute(f"select {columns} from ({queries.ORACLE_SQL['op13_collocations'].strip().rstrip(';')}) as t").fetchall()
    assert want and sorted(map(tuple, out.collect())) == sorted(want)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, SF_SMALL)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert out and {r["law"] for r in out} == {"bytes"} and len({(r["shard"], r["slot"]) for r in out}) == len(out)
