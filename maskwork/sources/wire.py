"""Stored chat traffic in its two wire shapes: request bodies, event streams, responses.

Bodies are parsed once to VARIANT and checked in the row; nothing is shuffled.  Field names
are matched exactly.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.functions.classify import finish_reason, parse_role, stop_reason_in
from maskwork.operators.ranking import sliced_rank


def field(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "variant")


def kind_of(value: Column) -> Column:
    """JSON type of a variant: STRING, BOOLEAN, BIGINT, ARRAY<..>, OBJECT<..>, VOID; NULL if absent."""
    return F.schema_of_variant(value)


def is_missing(value: Column) -> Column:
    return F.coalesce(kind_of(value) == "VOID", F.lit(True))


def is_array(value: Column) -> Column:
    return F.coalesce(kind_of(value).startswith("ARRAY"), F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(kind_of(value).startswith("OBJECT"), F.lit(False))


def is_string(value: Column) -> Column:
    return F.coalesce(kind_of(value) == "STRING", F.lit(False))


def text_of(value: Column) -> Column:
    """A string variant as text, NULL for anything else."""
    return F.when(is_string(value), F.try_variant_get(value, "$", "string"))


def items(value: Column) -> Column:
    return F.when(is_array(value), F.try_variant_get(value, "$", "array<variant>"))


def _whole(value: Column) -> Column:
    """An integer variant as BIGINT; a missing one is 0; NULL for other types."""
    number = F.when(F.coalesce(kind_of(value) == "BIGINT", F.lit(False)), F.try_variant_get(value, "$", "bigint"))
    return F.when(is_missing(value), F.lit(0).cast("bigint")).otherwise(number)


def content_text(content: Column) -> Column:
    """struct<text, problem> of a content field: a string, or text blocks put together."""
    blocks = items(content)
    block_ok = F.forall(
        blocks, lambda b: is_object(b) & (is_missing(field(b, "type")) | is_string(field(b, "type")))
        & (is_missing(field(b, "text")) | is_string(field(b, "text")))
    )
    all_text = F.forall(blocks, lambda b: F.coalesce(text_of(field(b, "type")) == "text", F.lit(False)))
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(text_of(field(b, "text")), F.lit(""))), "")
    missing = is_missing(content)
    text = F.when(missing, "").when(is_string(content), text_of(content)).when(block_ok & all_text, joined)
    problem = (
        F.when(missing | is_string(content), F.lit(None).cast("string"))
        .when(blocks.isNull() | ~block_ok, "content must be a string or array of text parts")
        .when(~all_text, "unsupported content part type")
    )
    return F.struct(text.alias("text"), problem.alias("problem"))


def _canonical(df: DataFrame, body: str, with_system: bool) -> DataFrame:
    doc = F.col("__doc")
    staged = df.withColumn("__doc", F.try_parse_json(body))
    model, msgs, stream = field(doc, "model"), field(doc, "messages"), field(doc, "stream")
    staged = staged.withColumn(
        "__msgs",
        F.transform(
            F.coalesce(items(msgs), F.array().cast("array<variant>")),
            lambda m, i: F.struct(
                i.cast("int").alias("i"), is_object(m).alias("ok"),
                (is_missing(field(m, "role")) | is_string(field(m, "role"))).alias("role_ok"),
                parse_role(F.coalesce(text_of(field(m, "role")), F.lit(""))).alias("role"),
                content_text(field(m, "content")).alias("c"),
            ),
        ),
    )
    rows = F.col("__msgs")
    decoded = (
        is_object(doc)
        & (is_missing(model) | is_string(model))
        & (is_missing(stream) | F.coalesce(kind_of(stream) == "BOOLEAN", F.lit(False)))
        & (is_missing(msgs) | is_array(msgs))
        & F.forall(rows, lambda r: r["ok"] & r["role_ok"])
    )
    bad = F.filter(rows, lambda r: r["c"]["problem"].isNotNull())
    first_bad = F.get(bad, F.lit(0))
    problem = F.concat(F.lit("message["), first_bad["i"].cast("string"), F.lit("]: "), first_bad["c"]["problem"])
    messages = F.transform(rows, lambda r: F.struct(r["role"].alias("role"), r["c"]["text"].alias("text")))
    error = (
        F.when(~decoded, "invalid body")
        .when((F.coalesce(text_of(model), F.lit("")) == "") | (F.size(rows) == 0), "missing model or messages")
    )
    if with_system:
        max_tokens = _whole(field(doc, "max_tokens"))
        system = content_text(field(doc, "system"))
        decoded = decoded & max_tokens.isNotNull()
        error = (
            F.when(~decoded, "invalid body")
            .when((F.coalesce(text_of(model), F.lit("")) == "") | (F.size(rows) == 0), "missing model or messages")
            .when(max_tokens <= 0, "max_tokens is required and must be > 0")
            .when(system["problem"].isNotNull(), F.concat(F.lit("system: "), system["problem"]))
        )
        first = F.array(F.struct(F.lit("system").alias("role"), system["text"].alias("text")))
        messages = F.when(system["text"] != "", F.concat(first, messages)).otherwise(messages)
    error = error.when(F.size(bad) > 0, problem)
    streaming = F.coalesce(F.when(kind_of(stream) == "BOOLEAN", F.try_variant_get(stream, "$", "boolean")), F.lit(False))
    return (
        staged.withColumn("error", error)
        .withColumn("model", F.when(F.col("error").isNull(), text_of(model)))
        .withColumn("mode", F.when(F.col("error").isNull(), F.when(streaming, "streaming").otherwise("unary")))
        .withColumn("messages", F.when(F.col("error").isNull(), messages))
        .drop("__doc", "__msgs")
    )


def read_openai_requests(df: DataFrame, body: str) -> DataFrame:
    """Add model, mode, messages array<struct<role,text>> and error (NULL for accepted bodies)."""
    return _canonical(df, body, with_system=False)


def read_anthropic_requests(df: DataFrame, body: str) -> DataFrame:
    """As above for the messages shape: the system field leads, max_tokens is required."""
    return _canonical(df, body, with_system=True)


def explode_messages(canonical: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Message parts (keys, msg_idx, role, modality, text) of the accepted bodies."""
    good = canonical.filter(F.col("error").isNull())
    rows = good.select(*keys, F.posexplode("messages").alias("msg_idx", "m"))
    return rows.select(*keys, "msg_idx", "m.role", F.lit("text").alias("modality"), "m.text")


# --- event streams ------------------------------------------------------------------------

_DATA = "data: "


def _cut_and_number(
    payloads: DataFrame, stream: str, line_no: str, stop: Column, counts: Column, block: int
) -> DataFrame:
    """Drop what follows the first stop or undecodable line, and number the counted events.

    The cut is a minimum per stream and numbering goes by slices of lines, so a giant
    stream is not sorted in one task.
    """
    bad = ~is_object(F.col("__doc")) & ~stop
    marked = payloads.withColumn("__bad", bad).withColumn("__stop", stop).withColumn("__counts", counts & ~bad & ~stop)
    ends = marked.filter(F.col("__bad") | F.col("__stop")).groupBy(stream).agg(F.min(line_no).alias("__end"))
    live = marked.join(ends, stream, "left").filter(
        F.col("__end").isNull() | (F.col(line_no) < F.col("__end")) | ((F.col(line_no) == F.col("__end")) & F.col("__bad"))
    )
    wanted = live.filter(F.col("__counts") | F.col("__bad"))
    ranked = sliced_rank(wanted, [stream], [line_no], F.floor(F.col(line_no) / block), out="__seq")
    # An undecodable line ends the stream and carries the number reached so far.
    return ranked.withColumn("seq", F.when(F.col("__bad"), F.col("__seq") - 1).otherwise(F.col("__seq")))


def _payloads(lines: DataFrame, stream: str, line_no: str, line: str) -> DataFrame:
    data = lines.filter(F.col(line).startswith(_DATA)).select(
        stream, line_no, F.substr(F.col(line), F.lit(len(_DATA) + 1)).alias("__payload")
    )
    return data.withColumn("__doc", F.try_parse_json("__payload"))


def read_openai_sse(lines: DataFrame, stream: str, line_no: str, line: str, block: int = 4096) -> DataFrame:
    """Chunks of each stream: stream, seq, delta, finish, err. Reading stops at [DONE]."""
    p = _payloads(lines, stream, line_no, line)
    numbered = _cut_and_number(p, stream, line_no, F.col("__payload") == "[DONE]", F.lit(True), block)
    choice = F.try_variant_get("__doc", "$.choices[0]", "variant")
    finish = text_of(field(choice, "finish_reason"))
    chunks = numbered.filter(F.col("__bad") | ~is_missing(choice))
    return chunks.select(
        stream, "seq",
        F.when(~F.col("__bad"), F.coalesce(text_of(F.try_variant_get(choice, "$.delta.content", "variant")), F.lit(""))).alias("delta"),
        F.when(~F.col("__bad") & (F.coalesce(finish, F.lit("")) != ""), finish_reason(finish)).alias("finish"),
        F.when(F.col("__bad"), "provider").alias("err"),
    )


def read_anthropic_sse(lines: DataFrame, stream: str, line_no: str, line: str, block: int = 4096) -> DataFrame:
    """The same for the typed event stream: only text deltas and stop reasons make chunks."""
    p = _payloads(lines, stream, line_no, line)
    doc = F.col("__doc")
    kind = F.coalesce(text_of(field(doc, "type")), F.lit(""))
    text = text_of(F.try_variant_get(doc, "$.delta.text", "variant"))
    is_text = (kind == "content_block_delta") & (text_of(F.try_variant_get(doc, "$.delta.type", "variant")) == "text_delta") & (text != "")
    reason = text_of(F.try_variant_get(doc, "$.delta.stop_reason", "variant"))
    is_finish = (kind == "message_delta") & (reason != "")
    counts = F.coalesce(is_text, F.lit(False)) | F.coalesce(is_finish, F.lit(False))
    numbered = _cut_and_number(p, stream, line_no, kind == "message_stop", counts, block)
    return numbered.select(
        stream, "seq",
        F.when(~F.col("__bad"), F.when(kind == "content_block_delta", text).otherwise("")).alias("delta"),
        F.when(~F.col("__bad") & (kind == "message_delta"), stop_reason_in(reason)).alias("finish"),
        F.when(F.col("__bad"), "provider").alias("err"),
    )


# --- responses ----------------------------------------------------------------------------


def read_responses(df: DataFrame, body: str, shape: str) -> DataFrame:
    """Add role, text, model, input_tokens, output_tokens, total_tokens and error to unary responses."""
    doc = F.col("__doc")
    staged = df.withColumn("__doc", F.try_parse_json(body))
    if shape == "openai":
        choice = F.try_variant_get(doc, "$.choices[0]", "variant")
        text = F.coalesce(text_of(F.try_variant_get(choice, "$.message.content", "variant")), F.lit(""))
        role = parse_role(F.coalesce(text_of(F.try_variant_get(choice, "$.message.role", "variant")), F.lit("")))
        tokens = [_whole(F.try_variant_get(doc, f"$.usage.{n}", "variant")) for n in ("prompt_tokens", "completion_tokens", "total_tokens")]
        empty = ~is_array(field(doc, "choices")) | (F.coalesce(F.size(items(field(doc, "choices"))), F.lit(0)) == 0)
        error = F.when(~is_object(doc), "decode").when(empty, "empty choices")
    else:
        blocks = F.filter(
            F.coalesce(items(field(doc, "content")), F.array().cast("array<variant>")),
            lambda b: F.coalesce(text_of(field(b, "type")) == "text", F.lit(False)),
        )
        text = F.array_join(F.transform(blocks, lambda b: F.coalesce(text_of(field(b, "text")), F.lit(""))), "")
        role = F.lit("assistant")
        used = [_whole(F.try_variant_get(doc, f"$.usage.{n}", "variant")) for n in ("input_tokens", "output_tokens")]
        tokens = [*used, used[0] + used[1]]
        error = F.when(~is_object(doc), "decode")
    ok = F.col("error").isNull()
    names = ("input_tokens", "output_tokens", "total_tokens")
    return staged.withColumn("error", error).select(
        *df.columns, F.when(ok, role).alias("role"), F.when(ok, text).alias("text"),
        F.when(ok, F.coalesce(text_of(field(doc, "model")), F.lit(""))).alias("model"),
        *[F.when(ok, t).alias(n) for t, n in zip(tokens, names)], "error",
    )


def render_openai(df: DataFrame, request_id: str, created: str, out: str = "body", prefix: str = "resp-") -> DataFrame:
    """JSON body of the first response shape from text, model and token columns."""
    message = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
    usage = F.struct(
        F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens"), "total_tokens"
    )
    return df.withColumn(out, F.to_json(F.struct(
        F.concat(F.lit(prefix), F.col(request_id).cast("string")).alias("id"), F.lit("chat.completion").alias("object"),
        F.col(created).alias("created"), "model", F.array(choice).alias("choices"), usage.alias("usage"),
    )))


def render_anthropic(df: DataFrame, request_id: str, out: str = "body", prefix: str = "resp-") -> DataFrame:
    # An empty text is left out of its block.
    block = F.struct(F.lit("text").alias("type"), F.nullif(F.col("text"), F.lit("")).alias("text"))
    return df.withColumn(out, F.to_json(F.struct(
        F.concat(F.lit(prefix), F.col(request_id).cast("string")).alias("id"), F.lit("message").alias("type"),
        F.lit("assistant").alias("role"), "model", F.array(block).alias("content"), F.lit("end_turn").alias("stop_reason"),
        F.struct("input_tokens", "output_tokens").alias("usage"),
    )))
