"""Reading the published dump and the sweep's files; writing and registering tables."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .records import read_quoted

# The dump's columns, by position.
TABLES = {
    "empresas": "cnpj_basico razao_social natureza_juridica qualificacao_responsavel capital_social porte ente_federativo",
    "estabelecimentos": (
        "cnpj_basico cnpj_ordem cnpj_dv matriz_filial nome_fantasia situacao_cadastral data_situacao_cadastral motivo_situacao_cadastral cidade_exterior pais "
        "data_inicio_atividade cnae_principal cnae_secundaria tipo_logradouro logradouro numero complemento bairro cep uf municipio ddd1 telefone1 ddd2 telefone2 ddd_fax fax "
        "email situacao_especial data_situacao_especial"
    ),
    "simples": "cnpj_basico opcao_simples data_opcao_simples data_exclusao_simples opcao_mei data_opcao_mei data_exclusao_mei",
    "socios": "cnpj_basico identificador_socio nome_socio cnpj_cpf_socio qualificacao_socio data_entrada pais cpf_representante nome_representante qualificacao_representante faixa_etaria",
}
CODE_TABLES = ("cnaes", "municipios", "naturezas", "motivos", "paises", "qualificacoes")
FILES = {
    "empresas": "Empresas*", "estabelecimentos": "Estabelecimentos*", "socios": "Socios*", "simples": "Simples*", "cnaes": "Cnaes*", "municipios": "Municipios*",
    "naturezas": "Naturezas*", "motivos": "Motivos*", "paises": "Paises*", "qualificacoes": "Qualificacoes*",
}
#: Quotes are doubled inside quoted fields, which can hold line ends; empty fields stay empty text.
CSV = {"sep": ";", "quote": '"', "escape": '"', "encoding": "ISO-8859-1", "multiLine": "true", "emptyValue": "", "nullValue": "\u0000"}
ITEMS = "array<struct<value: string, source_url: string>>"
SITE_SCHEMA = f"domain string, cnpj string, status string, final_url string, pages array<string>, crawled_at long, whatsapp {ITEMS}, phones {ITEMS}, emails {ITEMS}, social {ITEMS}"
COMPANIES = "array<struct<cnpj: string, razao: string, fantasia: string, municipio: string, cep: string, tels: array<string>>>"


def raw_schema(table: str) -> StructType:
    return StructType([StructField(c, StringType()) for c in TABLES.get(table, "codigo descricao").split()])


def read_dump(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All shards of a raw table: every column text, empties as '', positional names."""
    return spark.read.schema(raw_schema(table)).options(**CSV).csv(f"{folder}/{FILES[table]}")


def shard_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(table, path, bytes) of the dump's files that are there."""
    files = spark.read.format("binaryFile").load(folder).select(F.col("path"), F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    table = F.coalesce(*(F.when(name.like(pattern.replace("*", "%")), t) for t, pattern in FILES.items()))
    return files.select(table.alias("table"), "path", "bytes").where("table IS NOT NULL")


def write_raw(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path, compression="zstd")


def ingest_dump(spark: SparkSession, folder: str, target: str, tables: Collection[str] = tuple(FILES)) -> dict[str, DataFrame]:
    """Every table of the dump, or those named, as raw Parquet under `target`, a partition for each shard; shards that are there already are not read again.

    A shard counts as done once the list of done ones names it, which is written after its rows; rows of an attempt
    that broke off are replaced. Shards that come later are added. Quoted fields can hold line ends; records.py cuts a
    shard into records all the same in as many tasks as it has splits. A compressed shard is one task's, so these should be many.
    """
    files, out = shard_catalogue(spark, folder).collect(), {}  # a few dozen files
    for table in tables:
        path, log = f"{target}/{table}", f"{target}/_shards/{table}"
        done = {r.shard for r in spark.read.schema("shard string").json(log).collect()} if exists(spark, log) else set()
        new = {r.path.rsplit("/", 1)[1]: r.path for r in files if r.table == table and r.path.rsplit("/", 1)[1] not in done}
        if new:
            rows = read_quoted(spark, sorted(new.values()), raw_schema(table))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path, compression="zstd")
            spark.createDataFrame([(n,) for n in sorted(new)], "shard string").coalesce(1).write.mode("append").json(log)
        out[table] = spark.read.schema(raw_schema(table)).parquet(path).select(*raw_schema(table).names)
    return out


def append_events(events: DataFrame, path: str) -> None:
    """Adds event rows to a table with a folder for each day of ts, so that reports over a window read only its days."""
    events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(path, compression="zstd")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Sweep records as JSON lines."""
    return spark.read.schema(SITE_SCHEMA).json(path)


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(domain, cnpj, companies) of a tab-separated list whose third column holds JSON."""
    rows = spark.read.schema("domain string, cnpj string, companies string").csv(path, sep="\t", quote="")
    return rows.withColumn("companies", F.from_json("companies", COMPANIES))


def not_done(targets: DataFrame, done: DataFrame, key: str = "domain") -> DataFrame:
    return targets.join(done.select(key).distinct(), key, "left_anti")


def write_sites(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path, compression="zstd")


def register_views(spark: SparkSession, tables: dict[str, str]) -> list[str]:
    """Temporary views over those of the named Parquet folders that are there."""
    there = [name for name, path in tables.items() if exists(spark, path)]
    for name in there:
        spark.read.parquet(tables[name]).createOrReplaceTempView(name)
    return there
