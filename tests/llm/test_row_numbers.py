"""Decisions are joined back to their rows however the second scan is split."""

import pytest
from pyspark.sql import functions as F

from rewardforge.llm import common, line_dedup, mixing, simhash, substring_dedup

TEXT = "eine zeile {0} hier\nzweite zeile {0} dort\ndritte zeile {0} da und noch etwas mehr davon\n" * 3


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """8 files; every third text occurs again."""
    path = str(tmp_path_factory.mktemp("numbers") / "documents.parquet")
    rows = [(i, TEXT.format(i if i % 3 else 0), "s") for i in range(48)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8, "doc_id").write.parquet(path)
    return path


@pytest.fixture
def splits(spark):
    """Sets how scans are split from now on: one file a task, or all files in one."""
    names = ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(n, None) for n in names]

    def split(single):
        for n, v in zip(names, ("128m", "8") if single else ("1", "1")):
            spark.conf.set(n, v)

    yield split
    for n, v in zip(names, before):
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def case(name, docs):
    if name == "keep_first":
        return simhash.keep_first(docs)
    if name == "mixed_texts":
        return mixing.mixed_texts(docs, block=16)
    if name == "remove_repeats":
        return substring_dedup.remove_repeats(docs, length=40, tuple_bytes=16).drop("spans")
    return line_dedup.remove_repeated_lines(docs)


@pytest.mark.parametrize(
    "name, derived",
    [("remove_repeated_lines", False), ("remove_repeated_lines", True), ("keep_first", False), ("mixed_texts", False), ("remove_repeats", False)],
)
def test_scans_split_unlike(spark, table, splits, monkeypatch, name, derived):
    def read():
        docs = spark.read.parquet(table)
        return docs.where("doc_id >= 0") if derived else docs

    splits(True)
    want = sorted(map(tuple, case(name, read()).collect()))
    modules = (simhash, common, substring_dedup, line_dedup)
    cut, turn = simhash.cut_lineage, [0]

    def cut_then_split(df):
        out = cut(df)
        turn[0] += 1
        splits(turn[0] % 2 == 0)
        return out

    for m in modules:
        monkeypatch.setattr(m, "cut_lineage", cut_then_split)
    found = case(name, read())
    splits(False)
    assert sorted(map(tuple, found.collect())) == want and turn[0]


def test_numbers_tell_rows_apart(spark, table, splits):
    docs = spark.read.parquet(table).select("doc_id")
    seen = []
    for single in (True, False):
        splits(single)
        seen.append(dict(map(tuple, common.numbered(docs, "n").collect())))
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 48
    twice = common.numbered(docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2)))), "n")
    assert twice.select("n").distinct().count() == 96
    both = common.numbered(spark.read.parquet(table, table), "n")
    assert both.select("n").distinct().count() == both.count() == 96


def test_many_files_are_told_apart():
    paths = [f"hdfs://store/documents.parquet/part-{i:06d}-0b2c.snappy.parquet" for i in range(200_000)]
    assert common.file_salt(paths, 43) == common.file_salt(paths[:8], 43) == "0"
    assert common.file_salt(paths[:300], 8) is None  # more files than numbers: the caller writes them


def test_numbers_of_files_of_any_length(spark, tmp_path):
    for rows in ([1], [1, 70000, 3]):
        path = str(tmp_path / f"t{len(rows)}")
        for i, n in enumerate(rows):
            spark.range(n).coalesce(1).write.mode("append").parquet(path)
        got = common.numbered(spark.read.parquet(path), "n")
        assert got.where("n < 0").count() == 0 and got.select("n").distinct().count() == sum(rows)
    assert common.numbered(spark.read.parquet(path).where("id < 0"), "n").count() == 0
