"""FASTQ records that cross splits, against plain Python."""

from __future__ import annotations

import gzip

import numpy as np
import pytest

from siteline.sources import readers as S
from siteline.sources import records


def reads_of(seed, n):
    r = np.random.default_rng(seed)
    long = lambda: int(r.choice([0, 1, 5, 40, 300], p=[0.1, 0.2, 0.3, 0.3, 0.1]))
    out = []
    for i in range(n):
        k = long()
        out.append((f"r{i} @x", "".join(r.choice(list("ACGTN"), k)), "".join(r.choice(list("@+I#"), k))))  # qualities look like names
    return out


def text_of(reads):
    return "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in reads)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "0")]
    for k, v in old.items():
        spark.conf.set(k, v)


def got(df):
    return sorted((r["file"].rsplit("/", 1)[1], r["ordinal"], r["name"], r["seq"], r["qual"]) for r in df.collect())


@pytest.mark.parametrize("size", [40, 1000, 1 << 20])
def test_records_across_splits(spark, tmp_path, small_splits, size):
    files = {"a.fastq": reads_of(1, 14), "b.fastq": reads_of(2, 1), "c.fastq": [], "d.fastq": reads_of(3, 5)}
    for name, reads in files.items():
        (tmp_path / name).write_text(text_of(reads))
    (tmp_path / "e.fastq").write_text(text_of(files["d.fastq"]) + "@cut\nACG\n+\n")  # ends within a record
    (tmp_path / "f.fastq.gz").write_bytes(gzip.compress(text_of(files["a.fastq"]).encode()))
    want = [(f, k, *r) for f, reads in files.items() for k, r in enumerate(reads)] + [("e.fastq", k, *r) for k, r in enumerate(files["d.fastq"])]
    want += [("e.fastq", 5, "cut", "ACG", None)] + [("f.fastq.gz", k, *r) for k, r in enumerate(files["a.fastq"])]
    small_splits(size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = got(S.fastq(spark, f"file://{tmp_path}"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == sorted(want, key=lambda r: r[:2])


def test_no_text_is_exchanged(spark, tmp_path, small_splits, monkeypatch):
    (tmp_path / "a.fastq").write_text(text_of(reads_of(4, 60)))
    small_splits(500)
    rows = records.raw(spark, f"file://{tmp_path}")
    splits = records.edges(rows)
    own = records.inside(rows, records.placed(splits))
    plan = own._jdf.queryExecution().sparkPlan().toString()
    assert splits.count() > 10 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    kept = records.crossing(records.placed(splits))
    assert own.count() + kept.select("file", (kept.ordinal / 4).cast("long").alias("k")).distinct().count() == 60
    assert kept.count() <= 6 * splits.count()
    whole = got(S.fastq(spark, f"file://{tmp_path}"))
    monkeypatch.setattr(records, "BROADCAST_SPLITS", 1)  # the way of more splits
    assert got(S.fastq(spark, f"file://{tmp_path}")) == whole and len(whole) == 60
