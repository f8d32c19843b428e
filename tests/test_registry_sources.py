"""The parallel reader of quoted text against the reader that takes a whole file, and upserts by bucket."""

import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.accounts import latest_checks
from ledgerline.sources import dump, keyed, records


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "64" if k.endswith("PartitionBytes") else "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def put(path, rows, end="\n"):
    path.write_bytes("".join(";".join('"' + x.replace('"', '""') + '"' for x in r) + end for r in rows).encode("latin-1"))


def test_records_across_splits_equal_the_whole_file_reader(spark, tmp_path, small_splits):
    rng = random.Random(6)
    signs = ["a", "é", ";", '"', "\n", "\n\n", " ", "0", ";;", '""', "Grãos"]
    for name in ("Socios0", "Socios1"):
        put(tmp_path / name, [tuple("".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(11)) for _ in range(60)])
    put(tmp_path / "Socios2", [("one", 'USINA "BV"\nGRÃOS', "", "x" * 500, "\n" * 200, *"abcdef"), ("last", *[""] * 10)])  # records longer than several splits
    (tmp_path / "Socios3").write_bytes(b'"no line end at the last"' + b';"x"' * 10)
    (tmp_path / "Socios4").write_bytes(b"")
    whole = dump.read_dump(spark, str(tmp_path), "socios")
    split = records.read_quoted(spark, str(tmp_path), dump.raw_schema("socios"))
    assert split.columns == [*whole.columns, "shard"]
    tasks = spark.read.option("lineSep", "\n").text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    assert tasks > 100  # splits that hold the begin of a line
    key = lambda rows: sorted(map(str, rows))
    assert key(split.drop("shard").collect()) == key(whole.collect()) and whole.count() == 123
    assert {r.shard: r["count"] for r in split.groupBy("shard").count().collect()} == {"Socios0": 60, "Socios1": 60, "Socios2": 2, "Socios3": 1}


def test_line_ends_of_other_systems_and_open_quotes(spark, tmp_path):
    put(tmp_path / "Cnaes.CSV", [("01", "a"), ("02", "b")], "\r\n")
    (tmp_path / "Cnaes2.CSV").write_bytes(b'"03";"c"\n\n"04";"open\nto the end')
    got = sorted((r.codigo, r.descricao) for r in records.read_quoted(spark, str(tmp_path), dump.raw_schema("cnaes")).collect())
    assert got[:3] == [("01", "a"), ("02", "b"), ("03", "c")] and got[3][0] == "04" and "to the end" in got[3][1]


CHECK = "number string, checked_at timestamp, wa_business_name string, wa_account_type string, has_photo boolean"


def test_an_upsert_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    rng, target, want = random.Random(8), str(tmp_path / "table"), {}
    merge = lambda new, old: latest_checks(new, old)

    def batch(numbers, day):
        rows = [(f"55{n}", datetime(2024, 1, day), f"name {n} {day}", rng.choice(["business", None]), True) for n in numbers]
        want.update({r[0]: r for r in rows if r[0] not in want or r[1] >= want[r[0]][1]})
        return spark.createDataFrame(rows, CHECK)

    live = lambda: {tuple(r) for r in spark.read.schema(CHECK).parquet(keyed.live_path(spark, target)).collect()}
    assert keyed.live_path(spark, target) is None and keyed.manifest(spark, target) == []
    assert len(keyed.upsert(batch(range(500), 2), target, "number", merge, 0, buckets=16)) == 16
    assert live() == set(want.values())
    before = {r.bucket: r.path for r in keyed.manifest(spark, target)}
    some = batch([3, 777], 5)
    touched = keyed.upsert(some, target, "number", merge, 1, buckets=99)
    after = {r.bucket: r.path for r in keyed.manifest(spark, target)}
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before[b]} == set(touched) and len(after) == 16
    assert live() == set(want.values()) and len(want) == 501
    # an epoch given again, an older check, an empty batch
    assert keyed.upsert(some, target, "number", merge, 1) == [] and keyed.versions(spark, target) == [0, 1]
    assert len(keyed.upsert(batch([4], 1), target, "number", merge, 2)) == 1 and live() == set(want.values())
    assert keyed.upsert(some.limit(0), target, "number", merge, 3) == [] and live() == set(want.values())
    # an attempt that broke off before its manifest was complete isn't seen
    (tmp_path / "table" / "manifest" / "v9").mkdir()
    assert keyed.versions(spark, target)[-1] == 3 and live() == set(want.values())
    removed = keyed.vacuum(spark, target, keep=1)
    assert set(removed) == {before[b] for b in touched} | ({after[b] for b in after} - {r.path for r in keyed.manifest(spark, target)})
    assert live() == set(want.values()) and keyed.versions(spark, target) == [3]
    assert keyed.upsert(spark.createDataFrame([], CHECK), str(tmp_path / "none"), "number", merge, 0) == [] and keyed.live_path(spark, str(tmp_path / "none")) is None


def test_figures_of_the_writes_equal_a_second_scan(spark, tmp_path):
    from ledgerline.plans import build, raw_demo

    raw = raw_demo.raw_dump(spark, "/root/testdata/sf0.001")
    paths = build.build_registry(spark, raw, str(tmp_path), "2024-01")
    e, partners, stats = spark.read.parquet(paths["est_cnpj"]), spark.read.parquet(paths["socios"]), spark.read.schema(build.STATS).json(paths["stats"])
    assert stats.drop("without_name").first().asDict() == build.snapshot_stats(e, partners, "2024-01").first().asDict()
    audit = lambda **f: sorted(map(str, build.audit(raw, e, partners, **f).collect()))
    assert audit(figures=stats) == audit()
    empty = {k: v.limit(0) for k, v in raw.items()}
    stats = spark.read.schema(build.STATS).json(build.build_registry(spark, empty, str(tmp_path / "empty"), "2024-02")["stats"]).first()
    assert (stats.month, stats.newest_opening, stats.establishments, stats.links) == ("2024-02", None, 0, 0)


def test_share_sketches_merge_over_months(spark):
    from ledgerline.operators import scores

    rows = spark.range(60_000).selectExpr("lpad(CAST(id % 20000 AS STRING), 8, '0') AS cnpj_basico", "if(id % 3 = 0, 'a@x.com', concat('m', id % 9, '@y.com ')) AS email", "'11' AS ddd1", "if(id < 5, '33334444', NULL) AS telefone1", "NULL AS ddd2", "NULL AS telefone2", "date_add(DATE'2020-01-01', CAST(id % 700 AS INT)) AS data_inicio_atividade")
    rows = rows.selectExpr("*").withColumn("ddd2", F.col("ddd2").cast("string")).withColumn("telefone2", F.col("telefone2").cast("string"))
    kept = scores.share_sketches(rows)
    merged = {(r.kind, r.value): r.n for r in scores.merged_shares(kept).collect()}
    exact = {("email", r.em): r.n for r in scores.mail_shares(rows).collect()} | {("phone", r.ph): r.n for r in scores.phone_shares(rows).collect()}
    assert merged["phone", "1133334444"] == 5 and all(abs(merged[k] - n) <= 0.03 * n for k, n in exact.items())
    # months added one by one: the estimate may differ by what sketches are off
    early, late = kept.where("month < '2021-01'"), kept.where("month >= '2021-01'")
    again = {(r.kind, r.value): r.n for r in scores.merged_shares(early.unionByName(late)).collect()}
    assert again.keys() == merged.keys() and all(abs(again[k] - n) <= 0.03 * n for k, n in merged.items())
    assert scores.share_sketches(rows.limit(0)).count() == 0
