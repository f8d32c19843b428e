"""The dump's raw tables (all text, codes, repeated roots, unknown codes) as views over the star-schema tables, in SQL that Spark and DuckDB both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .demo import PARTNERS, _tables

_ROOT = "lpad(CAST(c_custkey AS STRING), 8, '0')"
_DAY = "replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '')"
COMPANIES = f"""
SELECT {_ROOT} AS cnpj_basico, c_name AS razao_social, CASE c_custkey % 4 WHEN 0 THEN '2062' WHEN 1 THEN '2135' WHEN 2 THEN '2305' ELSE '9999' END AS natureza_juridica,
  '49' AS qualificacao_responsavel, CASE WHEN c_custkey % 33 = 0 THEN 'n/d' ELSE replace(CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS STRING), '.', ',') END AS capital_social,
  lpad(CAST(c_custkey % 6 AS STRING), 2, '0') AS porte, '' AS ente_federativo
FROM customer WHERE c_custkey % 71 <> 0
UNION ALL
SELECT {_ROOT}, '', '2062', '50', '0,00', '01', '' FROM customer WHERE c_custkey % 50 = 0
"""
ESTABLISHMENTS = f"""
SELECT lpad(CAST(o_custkey AS STRING), 8, '0') AS cnpj_basico, lpad(CAST(CAST(floor(o_orderkey / 100) AS BIGINT) AS STRING), 4, '0') AS cnpj_ordem, lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') AS cnpj_dv,
  CASE WHEN o_orderkey % 6 = 0 THEN '1' ELSE '2' END AS matriz_filial, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Loja ' || CAST(o_orderkey % 100 AS STRING) END AS nome_fantasia,
  CASE o_orderstatus WHEN 'F' THEN '02' WHEN 'O' THEN '08' ELSE '04' END AS situacao_cadastral, CASE o_orderkey % 11 WHEN 0 THEN '0' WHEN 1 THEN '00000000' WHEN 2 THEN '20240230' ELSE {_DAY} END AS data_situacao_cadastral,
  lpad(CAST(o_orderkey % 8 AS STRING), 2, '0') AS motivo_situacao_cadastral, '' AS cidade_exterior, '' AS pais, {_DAY} AS data_inicio_atividade, lpad(CAST((o_orderkey * 7919) % 10000000 AS STRING), 7, '0') AS cnae_principal,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '0147800,4711302' END AS cnae_secundaria, 'RUA' AS tipo_logradouro, 'A' AS logradouro, CAST(o_orderkey % 50 AS STRING) AS numero, '' AS complemento, 'CENTRO' AS bairro,
  lpad(CAST(o_custkey % 900 AS STRING), 8, '0') AS cep, CASE o_orderkey % 3 WHEN 0 THEN 'SP' WHEN 1 THEN 'MT' ELSE 'BA' END AS uf, lpad(CAST(o_orderkey % 30 AS STRING), 4, '0') AS municipio,
  '11' AS ddd1, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '32211234' END AS telefone1, '' AS ddd2, '' AS telefone2, '' AS ddd_fax, '' AS fax, '' AS email, '' AS situacao_especial, '' AS data_situacao_especial
FROM orders
"""
REGIME = f"""
SELECT {_ROOT} AS cnpj_basico, CASE c_custkey % 5 WHEN 0 THEN 'S' ELSE 'N' END AS opcao_simples, CASE WHEN c_custkey % 5 = 0 THEN '20230315' ELSE '0' END AS data_opcao_simples, '0' AS data_exclusao_simples,
  CASE c_custkey % 8 WHEN 0 THEN 'S' ELSE 'N' END AS opcao_mei, '0' AS data_opcao_mei, '0' AS data_exclusao_mei
FROM customer WHERE c_custkey % 3 <> 0
UNION ALL
SELECT {_ROOT}, 'S', '20240101', '0', 'S', '20240101', '0' FROM customer WHERE c_custkey % 40 = 1 AND c_custkey % 3 <> 0
"""
LINKS = f"""
SELECT cnpj_basico, CAST(identificador_socio AS STRING) AS identificador_socio, nome_socio, cnpj_cpf_socio, CASE identificador_socio WHEN 1 THEN '22' WHEN 2 THEN '49' ELSE '77' END AS qualificacao_socio,
  replace(CAST(data_entrada AS STRING), '-', '') AS data_entrada, '' AS pais, '***000000**' AS cpf_representante, '' AS nome_representante, '00' AS qualificacao_representante, faixa_etaria
FROM ({PARTNERS}) p
"""
NATURES = "SELECT '2062' AS codigo, 'Sociedade Limitada' AS descricao UNION ALL SELECT '2135', 'Individual' UNION ALL SELECT '2305', 'Eireli'"
REASONS = "SELECT lpad(CAST(n_nationkey AS STRING), 2, '0') AS codigo, 'Motivo ' || n_name AS descricao FROM nation WHERE n_nationkey < 7"
ACTIVITIES = "SELECT DISTINCT lpad(CAST((o_orderkey * 7919) % 10000000 AS STRING), 7, '0') AS codigo, 'Atividade ' || CAST((o_orderkey * 7919) % 100 AS STRING) AS descricao FROM orders WHERE o_orderkey % 10 < 7"
TOWNS = "SELECT lpad(CAST(n_nationkey AS STRING), 4, '0') AS codigo, n_name AS descricao FROM nation"
ROLES = "SELECT '22' AS codigo, 'Socio' AS descricao UNION ALL SELECT '49', 'Socio-Administrador'"
#: What the SQL of the checks starts with.
WITH_RAW = (
    f"WITH empresas AS ({COMPANIES}), estabelecimentos AS ({ESTABLISHMENTS}), simples AS ({REGIME}), links AS ({LINKS}), naturezas AS ({NATURES}), motivos AS ({REASONS}), "
    f"cnaes AS ({ACTIVITIES}), municipios AS ({TOWNS}), qualificacoes AS ({ROLES})"
)


def raw_dump(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "empresas": _tables(spark, sf_dir, COMPANIES, "customer"),
        "estabelecimentos": _tables(spark, sf_dir, ESTABLISHMENTS, "orders"),
        "simples": _tables(spark, sf_dir, REGIME, "customer"),
        "socios": _tables(spark, sf_dir, LINKS, "lineitem", "orders", "supplier"),
        "naturezas": spark.sql(NATURES),
        "motivos": _tables(spark, sf_dir, REASONS, "nation"),
        "cnaes": _tables(spark, sf_dir, ACTIVITIES, "orders"),
        "municipios": _tables(spark, sf_dir, TOWNS + " ", "nation"),
        "qualificacoes": spark.sql(ROLES),
    }
