"""Reports on usage events, in batch. Event rows: ts, event (initialize or tool_call), tool, caller, client_name, client_version, duration_ms, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import safe_label, version_label

SESSION_SECONDS = 3600
EDGES = (100, 500, 1000, 5000, 10000)
LABELS = ("<100ms", "100-499ms", "500-999ms", "1-5s", "5-10s", "10s+")
# Fixed values of the event protocol.
STATUSES = ("ok", "tool_error", "rpc_error", "http_4xx", "http_5xx", "exception", "aborted")
ERROR_NAMES = {
    "ValueError": "validation", "TypeError": "validation", "ValidationError": "validation", "TimeoutError": "timeout", "InterruptException": "timeout", "ConnectionException": "db_error",
    "IOException": "db_error", "OutOfMemoryException": "db_error", "BinderException": "db_error", "CatalogException": "db_error", "ParserException": "db_error",
}
BY_STATUS = {"ok": "none", "tool_error": "tool_error", "rpc_error": "rpc_error", "http_4xx": "http_error", "http_5xx": "http_error", "aborted": "aborted"}
ERROR_CLASSES = ("validation", "timeout", "db_error", "internal", "tool_error", "rpc_error", "rate_limit", "http_error", "aborted")
EXPECTED = ("validation", "busy", "not_found")
RESULT_BUCKETS = ("0", "1-10", "10-100", "100+", "unknown")
ARGUMENTS = (
    "uf municipio municipio_codigo cnae include_secondary cnae_strict cnae_secao situacao matriz_only porte natureza_juridica capital_min capital_max opened_from opened_to closed_from closed_to "
    "mei simples name_contains cep partner_name group_by unit metric order order_by limit offset include_contacts min_contact_score cnpj name contains cpf_middle logradouro_contains numero table text"
).split()


def duration_label(ms: Column) -> Column:
    """The label of a duration; an edge belongs to the bucket above it."""
    return reduce(lambda c, e: c.when(ms < e[0], e[1]), zip(EDGES[1:], LABELS[1:]), F.when(ms < EDGES[0], LABELS[0])).otherwise(F.when(ms.isNotNull(), LABELS[-1]))


def duration_bound(ms: Column) -> Column:
    """The upper bound of a duration's bucket, to which an edge belongs; null for negative, missing and non-finite ones."""
    valid = ms.isNotNull() & ~F.isnan(ms.cast("double")) & (ms >= 0) & (ms.cast("double") != float("inf"))
    return F.when(valid, reduce(lambda c, e: c.when(ms <= e, e), EDGES[1:], F.when(ms <= EDGES[0], EDGES[0])).otherwise(10001))


def result_bucket(rows: Column, control_rows: Column | None = None) -> Column:
    """How many rows a call gave back; page totals and truncation marks (control rows) don't count."""
    n = rows - F.coalesce(control_rows, F.lit(0)) if control_rows is not None else rows
    return F.when(n.isNull(), "unknown").when(n <= 0, "0").when(n <= 10, "1-10").when(n <= 100, "10-100").otherwise("100+")


def response_buckets(body: Column) -> Column:
    """array<string>: how many rows each message of a JSON response gave back, in RESULT_BUCKETS; nothing of the texts comes out.

    A message's data is its structured content, or its text blocks (one block: its JSON; several: a list of them). Lists
    count their rows without page totals and truncation marks, records their companies or partners, else one row.
    Errors give unknown; a body that isn't JSON, or has a text block that isn't, gives an empty array. The body and each
    text block are parsed once, into variants; all else are looks into these.
    """

    def get(v: Column, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(v, path, kind)

    def is_object(v: Column) -> Column:
        return F.schema_of_variant(v).startswith("OBJECT")

    def let(value: Column, then) -> Column:
        return F.transform(F.array(value), then)[0]  # value is worked out once, however often `then` names it

    def of_rows(rows: Column) -> Column:
        control = F.filter(rows, lambda r: get(r, "$.total_matching").isNotNull() | get(r, "$.truncated", "string").eqNullSafe("true"))
        return F.size(rows) - F.size(control)

    def of_record(data: Column) -> Column:
        lists = F.coalesce(*(F.size(get(data, f"$.{k}", "array<variant>")) for k in ("companies", "partners")))
        return F.coalesce(lists, F.when((F.schema_of_variant(data) == "OBJECT<>") | get(data, "$.error").isNotNull(), 0).otherwise(1))

    def of_data(data: Column) -> Column:
        rows = let(F.coalesce(get(data, "$", "array<variant>"), get(data, "$.result", "array<variant>")), of_rows)
        return let(F.coalesce(rows, F.when(is_object(data), of_record(data))), result_bucket)

    def of_texts(texts: Column) -> Column:
        # one text is the data, several are its rows
        whole = F.when(F.size(texts) == 1, of_data(texts[0])).otherwise(let(of_rows(texts), result_bucket))
        return F.when(F.forall(texts, lambda t: t.isNotNull()), whole)

    def of_message(m: Column) -> Column:
        blocks = F.coalesce(get(m, "$.result.content", "array<variant>"), F.array().cast("array<variant>"))
        texts = F.transform(F.filter(blocks, lambda b: get(b, "$.type", "string") == "text"), lambda b: F.try_parse_json(get(b, "$.text", "string")))
        structured = lambda data: F.when(data.isNotNull() & ~F.is_variant_null(data), of_data(data)).otherwise(let(texts, of_texts))
        failed = get(m, "$.result.isError", "string").eqNullSafe("true") | get(m, "$.error").isNotNull()
        return F.when(failed, "unknown").otherwise(let(get(m, "$.result.structuredContent"), structured))

    none = F.array().cast("array<string>")
    whole = lambda out: F.when(F.forall(out, lambda b: b.isNotNull()), out).otherwise(none)
    messages = lambda v: let(F.transform(F.coalesce(get(v, "$", "array<variant>"), F.array(v)), of_message), whole)
    return let(F.try_parse_json(body), lambda v: F.when(v.isNotNull(), messages(v)).otherwise(none))


def outcome(raised: Column, code: Column, body: Column) -> Column:
    """The outcome of a call: an exception, none sent, the http class, an error in the body, or ok."""
    tool = body.contains('"isError":true') | body.contains('"isError": true')
    head = F.substring(body, 1, 2000)
    rpc = head.contains('"error":{') | head.contains('"error": {')
    return F.when(raised, "exception").when(code == 0, "aborted").when(code >= 500, "http_5xx").when(code >= 400, "http_4xx").when(tool, "tool_error").when(rpc, "rpc_error").otherwise("ok")


def error_class(exception: Column, status: Column) -> Column:
    pick = lambda c, names: F.coalesce(*(F.when(c == k, v) for k, v in names.items()))
    return F.coalesce(pick(exception, ERROR_NAMES), pick(status, BY_STATUS), F.lit("internal"))


def recent(events: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return events.where(F.col("ts").cast("timestamp") >= now - F.make_dt_interval(F.lit(days)))


def attribute_sessions(events: DataFrame, seconds: int = SESSION_SECONDS, block_seconds: int = 3600) -> DataFrame:
    """Tool calls with the name and version of the caller's latest handshake, if it is less than `seconds` old.

    A blocked scan: the last handshake of each (caller, block of time) is found by partial aggregation, carried over the
    blocks' ends (a row a block), and within a block a window looks back over the block's own events. So a caller's
    events are spread over as many tasks as it has blocks; a shorter block suits callers with very many events.
    A handshake of the same instant comes before a call; of several, the one with the larger event_id counts.
    Events without a time come before all others, and those without a caller are one caller's.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    block = F.floor(micros / (block_seconds * 1_000_000)).cast("long")
    shake = F.struct("ts", "client_name", "client_version")
    opening = F.col("event") == "initialize"
    # a null caller or block as a value of its own, so that joins and windows deal by the same keys
    keys = [F.struct("caller").alias("of"), F.struct(block).alias("block")]
    rows = events.select("*", *keys)
    ends = events.select(*keys, "event", "event_id", "ts", "client_name", "client_version").groupBy("of", "block").agg(F.max_by(F.when(opening, shake), F.when(opening, F.struct("ts", "event_id"))).alias("end"))
    before = Window.partitionBy("of").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("of", "block", F.last("end", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("of", "block").orderBy("ts", F.when(opening, 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carried, ["of", "block"]).withColumn("last", F.coalesce(F.last(F.when(opening, shake), ignorenulls=True).over(within), "carried"))
    live = micros - F.unix_micros(F.col("last.ts").cast("timestamp")) < F.lit(seconds * 1_000_000)
    rows = rows.where("event = 'tool_call'").withColumns({"client_name": F.when(live, F.col("last.client_name")), "client_version": F.when(live, F.col("last.client_version"))})
    return rows.select(*events.columns)


def usage_totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(F.col("event") == "tool_call").alias("tool_calls"), F.count_if(F.col("event") == "initialize").alias("handshakes"))


def usage_by_tool(events: DataFrame) -> DataFrame:
    return events.where("event = 'tool_call'").groupBy("tool").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool")


def usage_by_client(events: DataFrame, top: int = 20) -> DataFrame:
    names = [F.coalesce("client_name", F.lit("(unknown)")).alias("client_name"), F.coalesce("client_version", F.lit("")).alias("client_version")]
    return events.where("event = 'tool_call'").groupBy(*names).agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "client_name", "client_version").limit(top)


def usage_by_day(events: DataFrame) -> DataFrame:
    return events.where("event = 'tool_call'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls")).orderBy("day")


def valid_calls(events: DataFrame, tools: list[str]) -> DataFrame:
    """Tool calls of known tools and statuses with a valid duration."""
    calls = events.where(F.col("event").eqNullSafe("tool_call") & F.col("tool").isin(tools) & F.col("status").isin(list(STATUSES)))
    return calls.withColumn("bound", duration_bound(F.col("duration_ms"))).where("bound IS NOT NULL")


def call_metrics(events: DataFrame, tools: list[str], every: str = "60 seconds") -> DataFrame:
    """(start, tool, status, bound, calls): counts of calls by minute, tool, outcome and duration bucket."""
    calls = valid_calls(events, tools).withColumn("ts", F.col("ts").cast("timestamp"))
    out = calls.groupBy(F.window("ts", every), "tool", "status", "bound").agg(F.count("*").alias("calls"))
    return out.select(F.col("window.start").alias("start"), "tool", "status", "bound", "calls")


def busy_gauge(samples: DataFrame, every: str = "1 minute") -> DataFrame:
    """(start, busy): the last sample (ts, busy) of each minute."""
    return samples.groupBy(F.window(F.col("ts").cast("timestamp"), every)).agg(F.max_by("busy", "ts").alias("busy")).select(F.col("window.start").alias("start"), "busy")


def error_issues(events: DataFrame) -> DataFrame:
    """(fingerprint, calls, first_ts, last_ts) of failed calls by tool and error class; expected outcomes are left out."""
    known = F.when(F.col("error_class").isin(list(ERROR_CLASSES)), F.col("error_class")).otherwise("internal")
    expected = F.coalesce(F.col("expected_outcome").isin(list(EXPECTED)), F.lit(False))
    failed = events.where((F.col("event") == "tool_call") & (F.col("status") != "ok") & ~expected)
    return failed.groupBy(F.concat_ws(":", F.lit("v1"), F.coalesce("tool", F.lit("unknown")), known).alias("fingerprint")).agg(F.count("*").alias("calls"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def rejections(events: DataFrame, every: str = "60 seconds") -> DataFrame:
    """(start, rejected): calls that were turned away (event rejected) by minute."""
    turned_away = events.where("event = 'rejected'").groupBy(F.window(F.col("ts").cast("timestamp"), every)).agg(F.count("*").alias("rejected"))
    return turned_away.select(F.col("window.start").alias("start"), "rejected")


def scrub_events(events: DataFrame, tools: list[str], arguments: list[str] = ARGUMENTS) -> DataFrame:
    """The allow-listed columns only, with unknown values replaced or made null and labels cut to safe characters.

    Of argument_names (comma-separated) only those of `arguments` stay, each once, sorted.
    """
    has = set(events.columns)
    get = lambda c, kind="string": F.col(c) if c in has else F.lit(None).cast(kind)
    number = lambda c: F.when(get(c, "double").between(0, 86_400_000), get(c, "double"))
    db, total = number("db_ms"), number("duration_ms")
    return events.select(
        "ts",
        F.when(get("tool").isin(tools), get("tool")).otherwise("(unknown)").alias("tool"),
        F.when(get("status").isin(list(STATUSES)), get("status")).otherwise("exception").alias("status"),
        duration_label(total).alias("duration_bucket"),
        F.when(get("result_bucket").isin(list(RESULT_BUCKETS)), get("result_bucket")).otherwise("unknown").alias("result_bucket"),
        F.when(get("error_class").isin(["none", *ERROR_CLASSES]), get("error_class")).alias("error_class"),
        safe_label(get("client_name")).alias("client_name"),
        safe_label(get("client_version"), 32).alias("client_version"),
        version_label(get("app_version")).alias("app_version"),
        F.when(get("deploy_version").isNotNull(), version_label(get("deploy_version"))).alias("deploy_version"),
        F.array_join(F.array_sort(F.array_intersect(F.split(get("argument_names"), ","), F.array(*(F.lit(a) for a in arguments)))), ",").alias("argument_names"),
        F.when(get("upstream").isin("none", "DB"), get("upstream")).alias("upstream"),
        number("upstream_ms").alias("upstream_ms"),
        F.when(get("cache") == "not_applicable", get("cache")).alias("cache"),
        total.alias("duration_ms"),
        db.alias("db_ms"),
        F.greatest(F.lit(0.0), total - F.coalesce(db, F.lit(0.0))).alias("local_ms"),
        F.hour("ts").alias("utc_hour"),
    )
