"""Agent traces: event streams to conversations and outcomes, exchange records, redaction, error texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.json_text import map_leaves, truthy
from runlens.functions.text import lines, literal, strip

#: Endings by the subtype of the last result event.
ENDINGS = {
    "error_max_turns": "max_turns", "error_max_budget_usd": "max_budget",
    "error_max_structured_output_retries": "max_output_retries", "error_during_execution": "execution_error",
}
#: Fields of a message in a record, headers that hold secrets, parameters kept, placeholder identity.
MESSAGE_FIELDS = ("role", "content", "id", "model", "stop_reason", "usage")
SECRET_HEADERS = ("authorization", "x-api-key", "cookie", "anthropic-organization-id")
PARAMS = ("max_tokens", "stream", "thinking", "output_config", "context_management")
NAME, EMAIL, HOME = "Alan Turing", "alan.turing@example.com", "/Users/aturing"
#: Markers of error texts, lower case.
USAGE_LIMIT = ("usage limit", "limit reached", "credit balance", "out of credit", "insufficient credit", "quota", "resets at", "reset at", "upgrade to")
TRANSIENT = (
    "rate limit", "rate_limit", "429", "overloaded", "overload", "529", "timeout", "timed out", "temporarily", "connection", "network",
    "reset by peer", "econnreset", "502", "503", "504", "bad gateway", "gateway timeout", "service unavailable", "401",
    "invalid authentication credentials", "authentication_error",
)


def events(traces: DataFrame, keys: list[str]) -> DataFrame:
    """traces (keys, raw): (keys, pos, event) - the lines that hold a JSON object; blank, broken and other lines are dropped."""
    flat = traces.select(*keys, F.posexplode(lines(F.coalesce("raw", F.lit("")))).alias("pos", "line"))
    flat = flat.select(*keys, "pos", F.try_parse_json(strip(F.col("line"))).alias("event"))
    return flat.where(F.schema_of_variant("event").startswith("OBJECT"))


def text_at(event: Column | str, path: str) -> Column:
    return F.try_variant_get(event, path, "string")


def last_event(stream: DataFrame, keys: list[str], kind: str | None = None) -> DataFrame:
    """(keys, event): the last object of a stream, or the last of one type; the event as JSON text."""
    rows = stream if kind is None else stream.where(text_at("event", "$.type") == kind)
    return rows.groupBy(*keys).agg(F.max_by(F.to_json("event"), "pos").alias("event"))


def outcomes(traces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome): how each run ended, by its last result event; truncated without one, no_output without events."""
    e = events(traces, keys)
    result = text_at("event", "$.type") == "result"
    last = F.max_by(F.struct(text_at("event", "$.subtype").alias("subtype"), F.coalesce(F.try_variant_get("event", "$.is_error", "boolean"), F.lit(False)).alias("is_error")), F.when(result, F.col("pos")))
    one = e.groupBy(*keys).agg(F.count_if(result).alias("n"), last.alias("r"))
    ending = F.when(F.col("r.subtype") == "success", F.when(F.col("r.is_error"), "finished_with_api_error").otherwise("finished"))
    for k, v in ENDINGS.items():
        ending = ending.when(F.col("r.subtype") == k, v)
    outcome = F.when(F.col("n").isNull(), "no_output").when(F.col("n") == 0, "truncated").otherwise(ending.otherwise("execution_error"))
    return traces.select(*keys).join(one, keys, "left").select(*keys, outcome.alias("outcome"))


def coarse_outcome(complete: Column) -> Column:
    """For a record of a proxy: null means there is none."""
    return F.when(complete.isNull(), "no_output").when(complete, "finished").otherwise("truncated")


def complete(subtype: Column, is_error: Column) -> Column:
    return F.coalesce((subtype == "success") & ~is_error, F.lit(False))


def content_blocks(messages: DataFrame, keys: list[str]) -> DataFrame:
    """messages (keys, pos, role, content): (keys, pos, block_pos, role, type, text, name, input), blocks of user, assistant and system messages.

    A text is one block (none if empty); thinking becomes reasoning; blocks of other types are dropped, and so are
    messages of other roles. A tool result's parts are joined by a blank line. `input` stays JSON text.
    """
    whole = F.try_variant_get("content", "$", "string")
    plain = F.schema_of_variant("content") == "STRING"
    items = F.when(~plain, F.try_variant_get("content", "$", "array<variant>"))
    one = F.when(plain & (whole != ""), F.array(F.to_variant_object(F.struct(F.lit("text").alias("type"), whole.alias("text")))))
    flat = messages.where(F.col("role").isin("user", "assistant", "system")).select(*keys, "pos", "role", F.posexplode(F.coalesce(one, items)).alias("block_pos", "b"))
    kind = text_at("b", "$.type")
    result = F.try_variant_get("b", "$.content", "variant")
    parts = F.filter(F.transform(F.try_variant_get("b", "$.content", "array<variant>"), lambda p: F.when(F.try_variant_get(p, "$.type", "string") == "text", F.try_variant_get(p, "$.text", "string"))), lambda t: t.isNotNull())
    flattened = F.when(F.schema_of_variant(result) == "STRING", text_at("b", "$.content")).otherwise(F.coalesce(F.array_join(parts, "\n\n"), F.lit("")))
    text = F.when(kind == "text", text_at("b", "$.text")).when(kind == "thinking", text_at("b", "$.thinking")).when(kind == "tool_result", flattened)
    named = F.when(kind == "thinking", "reasoning").when(kind.isin("text", "tool_use", "tool_result"), kind)
    out = flat.select(*keys, "pos", "block_pos", "role", named.alias("type"), text.alias("text"), text_at("b", "$.name").alias("name"), F.to_json(F.try_variant_get("b", "$.input", "variant")).alias("input"))
    return out.where("type is not null")


def blocks(traces: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks of an event stream's user and assistant messages in order."""
    e = events(traces, keys).where(text_at("event", "$.type").isin("user", "assistant"))
    return content_blocks(e.select(*keys, "pos", text_at("event", "$.message.role").alias("role"), F.try_variant_get("event", "$.message.content", "variant").alias("content")), keys)


def last_record(logs: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """logs (keys, raw): (keys, record) of a proxy's log. Lenient: the last line that holds an object. Strict: the last line that is not
    blank, an error if it is no JSON, null if it is no object."""
    flat = logs.select(*keys, F.posexplode(lines(F.coalesce("raw", F.lit("")))).alias("pos", "line")).where(strip(F.col("line")) != "")
    if strict:
        last = flat.groupBy(*keys).agg(F.max_by("line", "pos").alias("line"))
        record = F.parse_json(strip(F.col("line")))
        found = last.select(*keys, F.when(F.schema_of_variant(record).startswith("OBJECT"), F.to_json(record)).alias("record"))
    else:
        found = last_event(events(logs, keys), keys).withColumnRenamed("event", "record")
    return logs.select(*keys).distinct().join(found, keys, "left")


def conversation_of_proxy(records: DataFrame, keys: list[str]) -> DataFrame:
    """records (keys, record): the blocks of the whole session: the system prompt, all turns so far, the final assistant turn."""
    r = records.select(*keys, F.try_parse_json("record").alias("r"))
    turn = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    asked = F.transform(F.coalesce(F.try_variant_get("r", "$.request.body.messages", "array<variant>"), F.array().cast("array<variant>")), lambda m: turn(F.try_variant_get(m, "$.role", "string"), F.try_variant_get(m, "$.content", "variant")))
    first = F.array(turn(F.lit("system"), F.try_variant_get("r", "$.request.body.system", "variant")))
    final = F.array(turn(F.lit("assistant"), F.try_variant_get("r", "$.response.message.content", "variant")))
    flat = r.select(*keys, F.posexplode(F.concat(first, asked, final)).alias("pos", "m"))
    return content_blocks(flat.select(*keys, "pos", "m.role", "m.content"), keys)


def conversations(traces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_messages, n_blocks): messages that keep a block, and their blocks."""
    return blocks(traces, keys).groupBy(*keys).agg(F.countDistinct("pos").alias("n_messages"), F.count("*").alias("n_blocks"))


def tool_results(found: DataFrame, keys: list[str], ids: DataFrame) -> DataFrame:
    """An extension: tool uses with their results, ids (keys, pos, block_pos, use_id) naming both."""
    b = found.join(ids, [*keys, "pos", "block_pos"])
    use = b.where("type = 'tool_use'").select(*keys, "use_id", "name", "input")
    return use.join(b.where("type = 'tool_result'").select(*keys, "use_id", F.col("text").alias("result")), [*keys, "use_id"], "left")


def _object(fields: dict[str, Column]) -> Column:
    """A JSON object of texts that are JSON themselves; null fields are written."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _at(v: Column | str, path: str) -> Column:
    """What stands at a path, as JSON text."""
    return F.to_json(F.try_variant_get(v, path, "variant"))


def _scrubbed(v: Column, path: str, scrub) -> Column:
    """An object's members as JSON text through `scrub` (a map of such texts); what is no object stays as it is."""
    whole = F.transform_values(F.try_variant_get(v, path, "map<string,variant>"), lambda k, x: F.to_json(x))
    quoted = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    listed = F.transform(F.map_entries(scrub(whole)), lambda m: F.concat(quoted(m["key"]), F.lit(":"), m["value"]))
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("OBJECT"), F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}"))).otherwise(_at(v, path))


def _message(m: Column) -> Column:
    """The canonical fields of a message as JSON text, null where it has none."""
    return _object({f: _at(m, f"$.{f}") for f in MESSAGE_FIELDS})


def _listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def exchange_of_proxy(records: DataFrame, keys: list[str], home: str = "", name: str = "", email: str = "") -> DataFrame:
    """records (keys, record): (keys, exchange), the unified record as JSON text: source, complete, model, messages, system, tools, extra_info.

    Secret headers and the user's id are taken out, and every text value in it is redacted. A null record gives null.
    """
    r = records.select(*keys, "record", F.try_parse_json("record").alias("r"))
    v = F.col("r")
    asked = F.coalesce(F.try_variant_get(v, "$.request.body.messages", "array<variant>"), F.array().cast("array<variant>"))
    answer = F.try_variant_get(v, "$.response.message", "variant")
    talk = F.concat(asked, F.when(_is_object(answer), F.array(answer)).otherwise(F.array().cast("array<variant>")))
    headers = lambda m: F.transform_values(m, lambda k, x: F.when(F.lower(k).isin(*SECRET_HEADERS), '"<redacted>"').otherwise(x))
    extra = _object({
        "request_headers": _scrubbed(v, "$.request.headers", headers), "response_headers": _scrubbed(v, "$.response.headers", headers), "status": _at(v, "$.response.status"),
        "request_params": _object({p: _at(v, f"$.request.body.{p}") for p in PARAMS}), "metadata": _scrubbed(v, "$.request.body.metadata", scrub_metadata),
    })
    whole = truthy(F.try_variant_get(v, "$.complete", "variant")).cast("string")
    record = _object({"source": F.lit('"proxy"'), "complete": whole, "model": _at(v, "$.request.body.model"), "messages": _listed(F.transform(talk, _message)), "system": _at(v, "$.request.body.system"), "tools": _at(v, "$.request.body.tools"), "extra_info": extra})
    return r.select(*keys, F.when(v.isNotNull(), redact_json(record, home, name, email)).alias("exchange"))


def exchange_of_stream(traces: DataFrame, keys: list[str], home: str = "", name: str = "", email: str = "") -> DataFrame:
    """traces (keys, raw): (keys, exchange), the same record of an event stream; a null raw (no file) gives null.

    The stream carries neither system prompt nor tools: both are null. `model` is the last assistant message's, complete
    means that the last result event tells of success without an error, and extra_info holds that event as it stands
    ({} without one). A row is one stream: nothing is shuffled.
    """
    parsed = F.filter(F.transform(lines(F.col("raw")), lambda x: F.try_parse_json(strip(x))), _is_object)
    e = traces.select(*keys, parsed.alias("e"))
    kind = lambda x: F.try_variant_get(x, "$.type", "string")
    said = lambda x: F.try_variant_get(x, "$.message", "variant")
    talk = F.filter("e", lambda x: F.coalesce(kind(x).isin("user", "assistant"), F.lit(False)) & _is_object(said(x)))
    e = e.select(*keys, F.col("e").isNotNull().alias("there"), talk.alias("talk"), F.try_element_at(F.filter("e", lambda x: kind(x) == "result"), F.lit(-1)).alias("result"))
    last = F.try_element_at(F.filter("talk", lambda x: kind(x) == "assistant"), F.lit(-1))
    whole = (text_at("result", "$.subtype") == "success") & ~truthy(F.try_variant_get("result", "$.is_error", "variant"))
    record = _object({
        "source": F.lit('"stream"'), "complete": F.coalesce(whole, F.lit(False)).cast("string"), "model": _at(said(last), "$.model"), "messages": _listed(F.transform("talk", lambda x: _message(said(x)))),
        "system": F.lit("null"), "tools": F.lit("null"), "extra_info": _object({"result": F.coalesce(F.to_json("result"), F.lit("{}"))}),
    })
    return e.select(*keys, F.when(F.col("there"), redact_json(record, home, name, email)).alias("exchange"))


def exchange_of_file(files: DataFrame, keys: list[str], home: str = "", name: str = "", email: str = "") -> DataFrame:
    """files (keys, capture, raw): (keys, exchange) of trace files of both kinds, `proxy` logs and `stream` logs.

    A file that is absent (null raw) and a proxy's log without a record give {}; a proxy's last line must be JSON.
    """
    proxy, stream = files.where("capture = 'proxy'"), files.where("capture = 'stream'")
    logged = exchange_of_proxy(last_record(proxy, keys, strict=True), keys, home, name, email)
    told = exchange_of_stream(stream, keys, home, name, email)
    return logged.unionByName(told).select(*keys, F.coalesce("exchange", F.lit("{}")).alias("exchange"))


def redact_json(record: Column, home: str = "", name: str = "", email: str = "") -> Column:
    """`redact` for every text value of a JSON text, wherever it stands; keys are left alone."""
    return map_leaves(record, lambda t: redact(t, home, name, email))


def scrub_headers(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*SECRET_HEADERS), "<redacted>").otherwise(v))


def scrub_metadata(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, v: k != "user_id")


def redact(text: Column, home: str = "", name: str = "", email: str = "") -> Column:
    """The placeholder identity in place of the given one, then in the sentences that name one. For a record's text leaves."""
    text = literal(literal(literal(text, home, HOME), name, NAME), email, EMAIL)
    text = F.regexp_replace(text, r"(The user's email address is )\S+", f"$1{EMAIL}")
    return F.regexp_replace(text, r"(Git user: )[^\n]+", f"$1{NAME}")


def error_class(text: Column) -> Column:
    """usage_limit, retryable (blank texts too) or fatal."""
    low = F.lower(text)
    some = lambda markers: F.greatest(*(low.contains(m) for m in markers))
    return F.when(strip(low) == "", "retryable").when(some(USAGE_LIMIT), "usage_limit").when(some(TRANSIENT), "retryable").otherwise("fatal")


def failure(stderr: Column, result: Column, api_status: Column) -> tuple[Column, Column]:
    """(class, message of at most 500 characters)"""
    part = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    text = F.concat_ws(" ", part(stderr), part(result), part(api_status))
    return error_class(text), F.left(strip(F.coalesce(part(result), part(stderr), part(text), F.lit("unknown failure"))), F.lit(500))


def active_seconds(exchange: Column) -> Column:
    """What the agent says it took, from a stream's record; null where the result names no number."""
    took = F.try_variant_get(F.try_parse_json(exchange), "$.extra_info.result.duration_ms", "variant")
    return F.when(F.schema_of_variant(took) != "STRING", F.try_variant_get(took, "$", "double") / 1000)
