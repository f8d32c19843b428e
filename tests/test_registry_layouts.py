"""Layouts that leave out what a look-up doesn't need, by the scans' own metrics, and the trigram index of names."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import queries as ask
from ledgerline.operators.filters import Filters
from ledgerline.operators.name_index import NameIndex, write_name_index
from ledgerline.plans import build


def scan_rows(df, named):
    """The result, and the rows that scans of paths with `named` in them gave to the plan."""
    rows, seen = df.collect(), []

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            walk(p.executedPlan())
        elif "QueryStage" in name:
            walk(p.plan())
        elif name.startswith("Scan parquet") and f"/{named}" in p.relation().location().rootPaths().toString():
            seen.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    assert seen
    return rows, sum(seen)


def establishments(spark, n=20_000):
    i = F.col("id")
    key = F.lpad(((i * 7919) % n).cast("string"), 8, "0")
    cols = {c: F.lit(None).cast("string") for c in build.ESTABLISHMENT_COLUMNS} | {
        "cnpj_basico": key, "cnpj": F.concat(key, F.lit("000191")), "matriz_filial": F.lit(1).cast("tinyint"), "uf": F.when(i % 2 == 0, "SP").otherwise("RJ"),
        "razao_social": F.concat(F.lit("Empresa "), F.sha2(i.cast("string"), 256).substr(1, 12)), "data_inicio_atividade": F.date_add(F.lit("2000-01-01").cast("date"), (i % 5000).cast("int")),
        "cnae_principal": F.lpad((i % 900).cast("string"), 7, "0"), "cnae_divisao": F.lpad((i % 90).cast("string"), 2, "0"),
    }
    return spark.range(0, n, 1, 4).select(*(c.alias(k) for k, c in cols.items()))


SMALL = {"parquet.page.size": str(4 << 10), "parquet.enable.dictionary": "false"}


def test_a_key_reads_one_row_group_of_the_sorted_layout(spark, tmp_path):
    build.write_by_key(establishments(spark), str(tmp_path / "by_key"), "cnpj", block_bytes=64 << 10, **SMALL)
    e = spark.read.parquet(str(tmp_path / "by_key"))
    rows, read = scan_rows(e.where("cnpj = '00012345000191'").select("cnpj", "razao_social"), "by_key")
    assert len(rows) == 1 and read <= 20_000 / 20
    rows, read = scan_rows(ask.of_root(e, "00000777").select("cnpj", "uf"), "by_key")
    assert len(rows) == 1 and read <= 20_000 / 20


def test_bloom_filters_find_a_key_in_the_layout_by_state(spark, tmp_path):
    plain, filtered = str(tmp_path / "plain"), str(tmp_path / "filtered")
    e = establishments(spark)
    build.write_by_state(e, filtered, block_bytes=64 << 10, **SMALL)
    build.write_by_state(e, plain, block_bytes=64 << 10, **SMALL, **{"parquet.bloom.filter.enabled#cnpj": "false"})
    asked = "cnpj = '00012345000191'"
    rows, without = scan_rows(spark.read.parquet(plain).where(asked).select("cnpj", "uf"), "plain")
    found, read = scan_rows(spark.read.parquet(filtered).where(asked).select("cnpj", "uf"), "filtered")
    assert rows == found and len(rows) == 1
    groups = [m.row_group(i).num_rows for f in Path(filtered).rglob("*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    # keys lie anywhere in this layout: statistics alone read nearly all of it, the filters leave the key's own row group
    assert len(groups) > 3 and read in groups and without > 0.8 * 20_000
    _, ranged = scan_rows(spark.read.parquet(filtered).where("uf = 'SP' AND cnae_principal = '0000042'").select("cnpj"), "filtered")
    assert 0 < ranged < 10_000


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(4)
    first, last = ["Ana", "José", "Conceição", "Luíz", "Zuleica", "ÁGATA"], ["da Silva", "Souza", "O'Neil", "de  Sá", "Xavier-Luz", "Ñuñez"]
    rows = [(f"{i % 700:08}", f"{rng.choice(first)} {rng.choice(last)} {rng.choice('QWXYZ')}{i % 37}") for i in range(3000)]
    rows += [("00000001", None), (None, "Ana Souza"), ("00000002", ""), ("00000003", "Al"), ("00000004", "X𝔘z 𝔘𝔘𝔘"), ("00000001", rows[1][1])]
    return spark.createDataFrame(rows, "cnpj_basico string, nome_socio string"), rows


def test_trigram_index_equals_a_scan(spark, people, tmp_path):
    frame, rows = people
    write_name_index(frame, "cnpj_basico", ["nome_socio"], str(tmp_path / "ix"))
    index = NameIndex(spark, str(tmp_path / "ix"))
    from ledgerline.functions.text import fold

    for text in ("silva q1", "CONCEIÇÃO", "nunez", "o'neil", "de  sa", "al", "z𝔘", "𝔘𝔘𝔘", "qqqqq", "ana souza", "xavier-luz w36"):
        scan = frame.where("cnpj_basico IS NOT NULL").where(fold(F.col("nome_socio")).contains(fold(F.lit(text))))
        got = index.narrowed(frame.where("cnpj_basico IS NOT NULL"), "cnpj_basico", text).where(fold(F.col("nome_socio")).contains(fold(F.lit(text))))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scan.collect())), text
    assert index.plan("qqqqq") == [] and index.plan("al") is None
    assert [n for _, n in index.plan("silva q1")] == sorted(n for _, n in index.plan("silva q1"))
    write_name_index(frame.limit(0), "cnpj_basico", ["nome_socio"], str(tmp_path / "none"))
    assert NameIndex(spark, str(tmp_path / "none")).narrowed(frame, "cnpj_basico", "silva").count() == 0


def test_names_that_many_rows_share_are_cut_once_and_no_row_holds_their_keys(spark, tmp_path, monkeypatch):
    i = F.col("id")
    rows = spark.range(6000).select(F.lpad(i.cast("string"), 8, "0").alias("k"), F.when(i % 3 == 0, "Bar do Zé").otherwise("Casa Ágata").alias("a"), F.when(i % 2 == 0, "BAR DO ZÉ").alias("b"))
    write_name_index(rows, "k", ["a", "b"], str(tmp_path / "ix"))
    index = NameIndex(spark, str(tmp_path / "ix"))
    # lists of keys by trigram were sets of thousands of keys in a task's memory
    assert not [f for t in (index.names, index.postings, index.counts) for f in t.schema.fields if f.dataType.typeName() == "array"]
    assert index.names.count() == 9000 and index.postings.count() == 2 * 7 + 8
    assert sorted((r.trigram, r.n, r.names) for r in index.counts.where("trigram IN ('bar', 'asa')").collect()) == [("asa", 4000, 1), ("bar", 5000, 2)]
    for limit in (50_000, 0):
        monkeypatch.setattr("ledgerline.operators.name_index.BROADCAST", limit)
        keys, most = index.keys("do ze")
        assert most == 5000 and {r.key for r in keys.collect()} == {f"{n:08}" for n in range(6000) if n % 3 == 0 or n % 2 == 0}


def test_search_inside_names_reads_a_small_part(spark, tmp_path, monkeypatch):
    e = establishments(spark)
    build.write_by_key(e, str(tmp_path / "by_key"), "cnpj", block_bytes=64 << 10, **SMALL)
    small = {"parquet.block.size": str(32 << 10), **SMALL}
    write_name_index(e, "cnpj", ["razao_social", "nome_fantasia"], str(tmp_path / "ix"), **small)
    e, index = spark.read.parquet(str(tmp_path / "by_key")), NameIndex(spark, str(tmp_path / "ix"))
    name = e.where("cnpj = '00012345000191'").first()
    part = name.razao_social[8:18]
    rows, read = scan_rows(ask.search_companies(e, Filters(uf=name.uf, name_contains=part), name_index=index), "by_key")
    assert [r.cnpj for r in rows] == [name.cnpj] and read <= 20_000 / 5
    keys, most = index.keys(part)
    total = index.postings.count()
    _, postings = scan_rows(keys, "postings")
    assert 0 < most < 500 and postings < total / 4
    monkeypatch.setattr("ledgerline.operators.name_index.NAMED", 0)  # a join in place of named keys: the same rows
    assert [r.cnpj for r in ask.search_companies(e, Filters(uf=name.uf, name_contains=part), name_index=index).collect()] == [name.cnpj]


def test_collated_columns_fold_by_themselves_in_any_script(spark, tmp_path):
    from ledgerline.functions import text

    towns = ["SÃO PAULO", "sao paulo", "São  Paulo", "Αθήνα", "ΑΘΗΝΑ", "Йошкар-Ола", "йошкар-ола", None, ""]
    rows = spark.createDataFrame([(str(i), t, "SP", f"Casa {t}") for i, t in enumerate(towns)], "cnpj string, municipio string, uf string, razao_social string").withColumn("nome_fantasia", F.lit(None).cast("string"))
    text.collated(rows, "municipio", "razao_social").write.parquet(str(tmp_path / "t"))
    e = spark.read.parquet(str(tmp_path / "t"))
    assert text.self_folding(e) == {"municipio", "razao_social"} and text.self_folding(text.plain(e)) == set()
    found = lambda **f: sorted(r.cnpj for r in Filters(**f).apply(e).select("cnpj").collect())
    assert found(municipio="Sao Paulo") == ["0", "1"] and found(municipio="αθηνα") == ["3", "4"] and found(municipio="ЙОШКАР-ола") == ["5", "6"]
    assert found(uf="SP", name_contains="ΘΗΝ") == ["3", "4"] and found(uf="SP", name_contains="casa s") == ["0", "1", "2"]
    assert "translate" not in Filters(municipio="x").apply(e)._jdf.queryExecution().optimizedPlan().toString()
    assert e.groupBy("municipio").count().where("count = 2").count() == 3
