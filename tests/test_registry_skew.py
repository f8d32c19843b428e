"""The registry operators under skew and over time: ownership, session attribution, state that expires."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import sites, usage
from ledgerline.streaming import jobs

EVENT = "event_id long, ts timestamp, event string, tool string, caller string, client_name string, client_version string, extra string"
DAY = datetime(2024, 1, 1)


def test_ownership_of_a_domain_with_very_many_companies(spark):
    pages = [("host.com.br", 1, "<title>Padaria Bela Vista</title><p>CNPJ 00.000.007/0001-07 CEP 78550-000</p>"), ("host.com.br", 2, "<p>Oficina Mecânica Zé em Sinop &amp; (11) 3254-7698</p>"), ("other.com.br", 1, "nothing"), ("unasked.com.br", 1, "text")]
    pages = spark.createDataFrame(pages, "domain string, page_no int, html string")
    n = 100_000
    made = spark.range(n).select(
        F.lit("host.com.br").alias("domain"),
        F.concat(F.lpad(F.col("id").cast("string"), 8, "0"), F.lit("000107")).alias("cnpj"),
        F.when(F.col("id") % 1000 == 1, "OFICINA MECANICA DO ZE LTDA").otherwise(F.concat(F.lit("EMPRESA NUMERO "), F.col("id").cast("string"))).alias("razao_social"),
        F.when(F.col("id") % 1000 == 2, "Padaria Bela Vista").alias("nome_fantasia"),
        F.when(F.col("id") % 1000 < 3, "Sinop").alias("municipio"),
        F.when(F.col("id") == 1002, "78550000").otherwise("00000001").alias("cep"),
        F.when(F.col("id") == 2001, F.array(F.lit("1132547698"))).alias("phones"),
    )
    more = spark.createDataFrame([("other.com.br", "1", None, None, None, None, None), ("other.com.br", "1", None, None, None, None, None), ("no.pages.br", "2", "X", "Y", "Z", "1", [])], "domain string, cnpj string, razao_social string, nome_fantasia string, municipio string, cep string, phones array<string>")
    out = sites.match_sites(pages, made.unionByName(more))
    assert "html" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
    got = {(r.domain, r.cnpj): (r.level, list(r.evidence)) for r in out.collect()}
    key = lambda i: ("host.com.br", f"{i:08}000107")
    assert len(got) == n + 1 and got["other.com.br", "1"] == ("candidate", [])
    assert got[key(7)] == ("confirmed", ["cnpj_on_page"]) and got[key(8)] == ("candidate", [])
    title, body = "name_multi_in_title/heading/copyright", "name_multi_in_body"
    assert got[key(2)] == ("confirmed", [title, "city"]) and got[key(1002)] == ("confirmed", [title, "cep"])
    assert got[key(1)] == ("likely", [body, "city"]) and got[key(2001)] == ("confirmed", [body, "phone"])


def by_loops(rows, seconds):
    """Each call with the latest handshake before it, caller by caller."""
    out = {}
    order = lambda r: (r[1] is not None, r[1] or DAY, r[2] != "initialize", r[0])
    last = {}
    for r in sorted(rows, key=order):
        if r[2] == "initialize":
            last[r[4]] = r
        elif r[2] == "tool_call":
            s = last.get(r[4])
            live = s is not None and None not in (r[1], s[1]) and (r[1] - s[1]).total_seconds() < seconds
            out[r[0]] = (s[5], s[6]) if live else (None, None)
    return out


@pytest.mark.parametrize("block", [60, 3600, 10**6])
def test_session_attribution_of_one_very_busy_caller(spark, block):
    rng, rows = random.Random(2), []
    for i in range(3000):
        caller = "busy" if i % 10 else rng.choice(["a", "b", None])
        ts = None if i % 400 == 0 else DAY + timedelta(seconds=rng.randint(0, 90_000))
        opening = rng.random() < 0.02
        rows.append((i, ts, "initialize" if opening else rng.choice(["tool_call", "tool_call", "rejected"]), "t", caller, f"c{i}" if opening else None, "1" if opening and i % 2 else None, "kept"))
    rows += [(9000 + k, DAY + timedelta(seconds=500), e, "t", "busy", f"tie{k}", "2", "kept") for k, e in enumerate(["tool_call", "initialize", "initialize"])]
    events = spark.createDataFrame(rows, EVENT)
    out = usage.attribute_sessions(events, 3000, block)
    assert out.columns == events.columns
    assert {r.event_id: (r.client_name, r.client_version) for r in out.collect()} == by_loops(rows, 3000)
    if block == 60:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            parts = usage.attribute_sessions(events, 3000, block).where("caller = 'busy'").groupBy(F.spark_partition_id()).count().collect()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert len(parts) == 4 and max(r[1] for r in parts) < 0.5 * sum(r[1] for r in parts)
    assert usage.attribute_sessions(events.limit(0), 3000).count() == 0


def test_stream_sessions_leave_no_state_of_silent_callers(spark, tmp_path):
    at = lambda **k: DAY + timedelta(**k)
    batches = [
        [(1, at(hours=0), "initialize", "t", "silent", "s", "1", ""), (2, at(hours=1), "tool_call", "t", "silent", None, None, ""), (3, at(hours=1), "initialize", "t", "late", "old", "1", "")],
        [(4, at(hours=1, minutes=5), "initialize", "t", "late", "new", "2", ""), (5, at(hours=1, minutes=2), "tool_call", "t", "late", None, None, "")],
        [(6, at(days=3), "initialize", "t", "other", "o", "1", "")],
        [(7, at(days=3, hours=1), "tool_call", "t", "other", None, None, ""), (8, at(hours=2), "tool_call", "t", "silent", None, None, "")],
        [(9, at(days=3, hours=2), "tool_call", "t", "silent", None, None, "")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
        q = jobs.attribute_sessions(stream, 86400).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        if i == 1:
            state = spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", "shakes").load()
            assert {r.key.caller for r in state.collect()} == {"silent", "late"}
    got = {r.event_id: (r.caller, r.client_name) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # 5 came after the younger handshake 4 and still belongs to 3; 8 is later than the watermark allows
    assert got == {2: ("silent", "s"), 5: ("late", "old"), 7: ("other", "o"), 9: ("silent", None)}
    state = spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", "shakes").load()
    assert {r.key.caller for r in state.collect()} == {"other"}
