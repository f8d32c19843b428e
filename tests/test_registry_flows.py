"""Queries over what jobs write make what they read and no more, leave no shuffle files, and put large tables down in shards by size."""

import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline import registered_flows as flows
from ledgerline.plans import build
from ledgerline.sources import dump, records, shared


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    i, day = F.col("id"), F.lit("1995-03-01").cast("timestamp")
    spark.range(40).select(i.alias("c_custkey"), F.concat(F.lit("Customer#"), i.cast("string")).alias("c_name"), (i * 1.5).alias("c_acctbal")).write.parquet(f"{folder}/customer.parquet")
    spark.range(300).select(i.alias("o_orderkey"), (i % 40).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), day.alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{folder}/orders.parquet")
    spark.range(900).select((i % 300).alias("l_orderkey"), (i % 7).alias("l_suppkey"), day.alias("l_shipdate")).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(7).select(i.alias("s_suppkey"), F.format_string("Supplier#%09d", i).alias("s_name")).write.parquet(f"{folder}/supplier.parquet")
    spark.range(25).select(i.cast("int").alias("n_nationkey"), F.concat(F.lit("N"), i.cast("string")).alias("n_name")).write.parquet(f"{folder}/nation.parquet")
    return folder


def fresh(spark, tables):
    flows._made.cache_clear()
    return flows.made(spark, tables)


def data_files(spark):
    return [p for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")]


def test_layout_by_state_makes_no_partners_and_leaves_no_shuffle_files(spark, tables):
    made, before = fresh(spark, tables), set(data_files(spark))
    assert flows.layout_by_state(spark, tables).count() > 0
    assert set(made.paths) == {"estabelecimentos"} and made.raw.put == {"estabelecimentos", "empresas", "simples", "cnaes", "naturezas", "motivos", "municipios"}
    # all but those of the count itself
    path, seen = made.path("estabelecimentos"), set(data_files(spark))
    assert len(seen - before) <= 4, path
    shared.written(spark.range(1000).repartition(7), "x")
    assert set(data_files(spark)) <= seen


def test_layout_by_key_makes_only_what_it_comes_from(spark, tables):
    made = fresh(spark, tables)
    flows.layout_by_key(spark, tables).collect()
    assert set(made.paths) == {"estabelecimentos", "est_cnpj"} and "socios" not in made.raw.put


def test_layout_partners_by_root_makes_only_partners(spark, tables):
    made = fresh(spark, tables)
    assert flows.layout_partners_by_root(spark, tables).count() > 0
    assert set(made.paths) == {"socios"} and made.raw.put == {"socios", "qualificacoes"}
    assert made.read("socios").where("nome_key <> lower(nome_socio)").count() >= 0 and "nome_key" in made.read("socios").columns


def test_layout_partners_by_name_makes_only_partners(spark, tables):
    made = fresh(spark, tables)
    flows.layout_partners_by_name(spark, tables).collect()
    assert set(made.paths) == {"socios", "socios_nome"} and made.raw.put == {"socios", "qualificacoes"}


def test_ingested_partners_take_one_pass_without_a_shuffle_of_lines(spark, tables):
    made = fresh(spark, tables)
    assert flows.ingested_partners(spark, tables).count() > 0 and made.paths == {} and made.raw.put == {"socios"}
    shards = [r.path for r in dump.shard_catalogue(spark, made.raw.folder).collect()]
    assert shards and all(p.endswith(".CSV.gz") for p in shards)
    plan = records.read_records(spark, shards)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and plan.count("MapInArrow") == 1
    plain = records._split_records(records._lines(spark, shards, "ISO-8859-1"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plain


def test_ingested_establishments_of_large_inputs_are_many_shards(spark, tables, monkeypatch):
    monkeypatch.setattr(flows, "SHARED_OUT", 0)
    monkeypatch.setattr(flows, "SHARD_ROWS", 50)
    made = fresh(spark, tables)
    rows = flows.ingested_establishments(spark, tables)
    assert rows.count() == 300 and rows.distinct().count() == 300
    assert dump.shard_catalogue(spark, made.raw.folder).count() >= 6 and made.raw.put == {"estabelecimentos"}


def test_shard_bytes_puts_two_tables_down_and_builds_nothing(spark, tables):
    made = fresh(spark, tables)
    assert flows.shard_bytes(spark, tables).count() == 2
    assert made.raw.put == {"empresas", "simples"} and made.raw.taken == {} and made.paths == {}


def test_ingested_codes_make_only_code_tables(spark, tables):
    made = fresh(spark, tables)
    assert flows.ingested_codes(spark, tables).where("codigo = '9999'").count() == 1
    assert set(made.paths) == made.raw.put == set(dump.CODE_TABLES)


def test_snapshot_makes_two_layouts(spark, tables):
    made = fresh(spark, tables)
    row = flows.snapshot_from_writes(spark, tables).first()
    assert (row.establishments, row.links) == (300, made.read("socios").count())
    assert set(made.paths) == {"estabelecimentos", "socios", "stats"}


def test_published_views_are_of_the_whole_build(spark, tables):
    made = fresh(spark, tables)
    assert {r["view"]: r.n for r in flows.published_views(spark, tables).collect()}["est_cnpj"] == 300
    assert set(made.paths) == set(made.layouts) and set(build.current(spark, f"{made.raw.folder}-built")) == set(made.layouts)


def test_compressed_shards_equal_plain_ones(spark, tmp_path):
    rng = random.Random(9)
    signs = ["a", "é", ";", '""', "\n", "\r\n", " ", "0"]
    (tmp_path / "gz").mkdir()
    (tmp_path / "txt").mkdir()
    for n in range(4):
        text = "".join(";".join('"' + "".join(rng.choices(signs, k=rng.randint(0, 9))) + '"' for _ in range(2)) + rng.choice(["\n", "\r\n"]) for _ in range(200)) + '"cut'
        (tmp_path / "txt" / f"Cnaes{n}").write_bytes(text.encode("latin-1"))
        (tmp_path / "gz" / f"Cnaes{n}.gz").write_bytes(gzip.compress(text.encode("latin-1")))
    rows = [sorted((r.shard.removesuffix(".gz"), r.record) for r in records.read_records(spark, sorted(map(str, (tmp_path / k).iterdir()))).collect()) for k in ("gz", "txt")]
    assert rows[0] == rows[1] and len(rows[0]) == 804
