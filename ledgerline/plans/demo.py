"""Registry-shaped views over the star-schema tables, in SQL that Spark and DuckDB both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import SECTIONS, section

#: The sections with their first and last divisions, as a table that the SQL of the checks joins.
SECTION_RANGES = f"(VALUES {', '.join(f"('{letter}', {first}, {last})" for letter, (first, last) in SECTIONS.items())}) AS ranges(letter, first, last)"

BASE = """
SELECT lpad(CAST(c_custkey AS STRING), 8, '0') AS cnpj_basico,
  lpad(CAST(c_custkey AS STRING), 8, '0') || lpad(CAST(o_orderkey AS STRING), 6, '0') AS cnpj,
  CASE WHEN o_orderkey = first_key THEN 1 ELSE 2 END AS matriz_filial,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Loja São ' || n_name || ' ' || CAST(o_orderkey % 100 AS STRING) END AS nome_fantasia,
  c_name || CASE WHEN c_custkey % 3 = 0 THEN ' Comércio Ltda' ELSE ' Serviços S/A' END AS razao_social,
  CASE c_custkey % 4 WHEN 0 THEN '2062' WHEN 1 THEN '2135' WHEN 2 THEN '2305' ELSE '3999' END AS natureza_juridica,
  CASE c_custkey % 4 WHEN 0 THEN 'Sociedade Empresária Limitada' WHEN 1 THEN 'Empresário (Individual)' WHEN 2 THEN 'Empresa Individual de Responsabilidade Limitada' ELSE 'Associação Privada' END AS natureza_juridica_descricao,
  c_acctbal AS capital_social,
  CASE c_mktsegment WHEN 'BUILDING' THEN '01' WHEN 'AUTOMOBILE' THEN '03' WHEN 'MACHINERY' THEN '05' WHEN 'HOUSEHOLD' THEN '00' ELSE '09' END AS porte,
  CASE o_orderstatus WHEN 'F' THEN '02' WHEN 'O' THEN '08' ELSE '04' END AS situacao_cadastral,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS data_situacao_cadastral,
  o_orderpriority AS motivo_situacao_descricao,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS data_inicio_atividade,
  lpad(CAST((o_orderkey * 7919) % 10000000 AS STRING), 7, '0') AS cnae_principal,
  'Atividade ' || CAST((o_orderkey * 7919) % 100 AS STRING) AS cnae_principal_descricao,
  substring(lpad(CAST((o_orderkey * 7919) % 10000000 AS STRING), 7, '0'), 1, 2) AS cnae_divisao,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE lpad(CAST((o_orderkey * 31) % 10000000 AS STRING), 7, '0') || ',' || lpad(CAST((o_orderkey * 57) % 10000000 AS STRING), 7, '0') END AS cnae_secundaria,
  CASE o_orderkey % 3 WHEN 0 THEN 'RUA' WHEN 1 THEN 'AVENIDA' ELSE 'PRACA' END AS tipo_logradouro,
  'São ' || n_name AS logradouro,
  CAST(o_orderkey % 50 AS STRING) AS numero,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'SALA ' || CAST(o_orderkey % 9 AS STRING) END AS complemento,
  'CENTRO' AS bairro,
  lpad(CAST(o_custkey % 900 AS STRING), 8, '0') AS cep,
  lpad(CAST(n_nationkey AS STRING), 4, '0') AS municipio_codigo,
  n_name AS municipio,
  CASE n_regionkey WHEN 0 THEN 'SP' WHEN 1 THEN 'MT' WHEN 2 THEN 'RJ' WHEN 3 THEN 'BA' ELSE 'EX' END AS uf,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CASE WHEN c_custkey % 11 = 0 THEN '00' ELSE '11' END END AS ddd1,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '9' || lpad(CAST(c_custkey % 500 AS STRING), 8, '8') WHEN 2 THEN '3' || lpad(CAST(c_custkey % 40 AS STRING), 7, '2') WHEN 3 THEN '77777777' WHEN 4 THEN '8' || lpad(CAST(c_custkey AS STRING), 7, '6') ELSE '12345678' END AS telefone1,
  '21' AS ddd2,
  CASE WHEN c_custkey % 10 = 0 THEN '2' || lpad(CAST(c_custkey % 30 AS STRING), 7, '5') END AS telefone2,
  CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'c' || CAST(c_custkey AS STRING) || '@gmail.com' WHEN 2 THEN 'x' || CAST(c_custkey % 15 AS STRING) || '@gmai.com' WHEN 3 THEN 'contabil' || CAST(c_custkey % 5 AS STRING) || '@escrita.com.br'
    WHEN 4 THEN ' Vendas@Loja' || CAST(c_custkey % 60 AS STRING) || '.com.br ' WHEN 5 THEN 'sem-arroba' WHEN 6 THEN 'a@' || lower(n_name) || '.com.br' WHEN 7 THEN 'b' || CAST(c_custkey AS STRING) || '@grupo.com.br' ELSE lower(c_name) || '@empresa' || CAST(c_custkey AS STRING) || '.com' END AS email,
  CASE c_custkey % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'N' END AS opcao_simples,
  CASE c_custkey % 8 WHEN 0 THEN 'S' WHEN 1 THEN 'N' WHEN 2 THEN '' END AS opcao_mei
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN (SELECT o_custkey AS first_cust, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey) f ON o_custkey = first_cust
"""
PARTNERS = """
SELECT lpad(CAST(o_custkey AS STRING), 8, '0') AS cnpj_basico, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' da Conceição' ELSE '' END AS nome_socio,
  CAST(s_suppkey % 3 + 1 AS INTEGER) AS identificador_socio, '***' || lpad(CAST(s_suppkey AS STRING), 6, '0') || '**' AS cnpj_cpf_socio,
  CASE s_suppkey % 2 WHEN 0 THEN 'Sócio' ELSE 'Sócio-Administrador' END AS qualificacao_socio_descricao, min(CAST(l_shipdate AS DATE)) AS data_entrada,
  CAST(s_suppkey % 10 AS STRING) AS faixa_etaria, CAST(NULL AS STRING) AS nome_representante
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
GROUP BY o_custkey, s_suppkey, s_name
"""
EVENTS = """
SELECT event_id, ts, CASE WHEN event_type = 'signup' THEN 'initialize' ELSE 'tool_call' END AS event, event_type AS tool, CAST(user_id AS STRING) AS caller,
  CASE WHEN event_type = 'signup' THEN 'client' || CAST(user_id % 30 AS STRING) END AS client_name,
  CASE WHEN event_type = 'signup' THEN '1.' || CAST(event_id % 3 AS STRING) END AS client_version,
  value * 100 AS duration_ms,
  CASE event_id % 9 WHEN 0 THEN 'tool_error' WHEN 1 THEN 'http_4xx' WHEN 2 THEN 'bogus' ELSE 'ok' END AS status,
  CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'validation' WHEN 2 THEN 'strange' END AS error_class,
  CASE WHEN event_id % 18 = 0 THEN 'validation' END AS expected_outcome
FROM events
"""
ESTABLISHMENTS = f"SELECT b.*, ranges.letter AS cnae_secao FROM ({BASE}) b LEFT JOIN {SECTION_RANGES} ON CAST(b.cnae_divisao AS INTEGER) BETWEEN ranges.first AND ranges.last"
#: What the SQL of the checks starts with.
WITH = f"WITH est AS ({ESTABLISHMENTS}), socios AS ({PARTNERS}), calls AS ({EVENTS})"


def _tables(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """SQL over the Parquet tables of a folder, as frames and not as session views."""
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    for n in names:
        sql = sql.replace(f" {n} ", f" {{{n}}} ").replace(f" {n}\n", f" {{{n}}}\n").replace(f" {n})", f" {{{n}}})")
    return spark.sql(sql, **frames)


def establishments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The establishment view; its section comes from the library's own function."""
    return _tables(spark, sf_dir, BASE, "orders", "customer", "nation").withColumn("cnae_secao", section(F.col("cnae_divisao")))


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir, PARTNERS, "lineitem", "orders", "supplier")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir, EVENTS, "events")
