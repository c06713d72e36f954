"""Chat formatting with linked tool calls, in DataFrame operations only.

Calls and results are joined by conversation and identifier, calls are put in topological
order of what they depend on, arguments are validated against the tools' schemas, and
every message, call and result becomes one line of canonical JSON (keys sorted, no blanks,
text as UTF-8). The order of a conversation is in columns, so no conversation is gathered
into one task, however long it is.

A call stands in an assistant message whose text is a JSON object with ``tool_calls``: an
array of {"id", "name", "arguments", "depends_on": [ids]}. A result is a tool message whose
text is a JSON object with ``tool_call_id`` and ``content``. All else is plain text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, empty

#: JSON schema type: pattern of the variant types that satisfy it.
TYPES = {
    "string": "^STRING",
    "integer": "^(BIGINT|INT|SMALLINT|TINYINT)",
    "number": "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)",
    "boolean": "^BOOLEAN",
    "object": "^OBJECT",
    "array": "^ARRAY",
    "null": "^VOID",
}
_KEY = ["conv_id", "call_id"]


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and plain messages of messages(conv_id, turn, role, text)."""
    base = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    object_like = F.col("text").startswith("{") & F.col("role").isin("assistant", "tool")
    parsed = base.withColumn("v", F.when(object_like, F.try_parse_json("text")))
    parsed = parsed.withColumn("calls", F.when(F.col("role") == "assistant", F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')")))
    parsed = parsed.withColumn("result_of", F.when(F.col("role") == "tool", F.expr("try_variant_get(v, '$.tool_call_id', 'string')")))
    carries = F.coalesce(F.size("calls") > 0, F.lit(False))
    calls = parsed.where(carries).select("conv_id", "turn", F.posexplode("calls").alias("pos", "c"))
    # arguments may be an object or a string that holds one
    inner = F.expr("try_variant_get(c, '$.arguments', 'variant')")
    calls = calls.withColumn("a", F.coalesce(F.when(F.schema_of_variant(inner) == "STRING", F.try_parse_json(F.expr("try_variant_get(c, '$.arguments', 'string')"))).otherwise(inner), F.parse_json(F.lit("{}"))))
    calls = calls.select(
        "conv_id", "turn", "pos",
        F.expr("try_variant_get(c, '$.id', 'string')").alias("call_id"),
        F.coalesce(F.expr("try_variant_get(c, '$.name', 'string')"), F.lit("")).alias("name"),
        F.to_json("a").alias("arguments"),
        F.coalesce(F.expr("try_variant_get(c, '$.depends_on', 'array<string>')"), F.array().cast("array<string>")).alias("needs"),
    )
    results = parsed.where("result_of IS NOT NULL").select("conv_id", "turn", F.col("result_of").alias("call_id"), F.to_json(F.coalesce(F.expr("try_variant_get(v, '$.content', 'variant')"), F.parse_json(F.lit("null")))).alias("content"))
    plain = parsed.where(~carries & F.col("result_of").isNull()).select("conv_id", "turn", "role", "text")
    return calls, results, plain


def topological_levels(calls: DataFrame, stage: Stage) -> DataFrame:
    """Level of each call(conv_id, call_id, needs): 0 without needs, else one above the highest of
    them; null for calls that are in or behind a circle. Needs that no call meets don't count.

    Each round settles the calls whose needs are settled, so rounds are as many as levels: the longest
    chain of needs in any conversation, however many conversations and turns there are.
    """
    nodes = stage.cut(calls.select(*_KEY).where("call_id IS NOT NULL").distinct(), "nodes")
    edges = calls.select(*_KEY, F.explode("needs").alias("need")).where("call_id IS NOT NULL").distinct()
    known = nodes.select("conv_id", F.col("call_id").alias("need"))
    edges = stage.cut(edges.join(known, ["conv_id", "need"], "left_semi"), "needs0")
    left, settled, level = nodes, None, 0
    while True:
        ready = stage.cut(left.join(edges.select(*_KEY).distinct(), _KEY, "left_anti").withColumn("level", F.lit(level)), f"ready{level}")
        if ready.isEmpty():
            break
        settled = ready if settled is None else settled.unionByName(ready)
        left = stage.cut(left.join(ready, _KEY, "left_anti"), f"left{level}")
        met = ready.select("conv_id", F.col("call_id").alias("need"))
        edges = stage.cut(edges.join(met, ["conv_id", "need"], "left_anti"), f"needs{level + 1}")
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if settled is None else settled.unionByName(rest)


def validate(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls with ``problems``: sorted, distinct texts, empty for valid arguments.

    tools(name, parameters): a JSON schema of an object; its properties' type and enum, required
    and additionalProperties (false) are checked. An unknown tool is a problem, and so are
    arguments that are no object. Of several tools of one name the least schema text counts.
    """
    spec = tools.where("name IS NOT NULL").groupBy("name").agg(F.min("parameters").alias("parameters")).withColumn("s", F.try_parse_json("parameters"))
    spec = spec.select(
        "name", F.lit(True).alias("known"),
        F.coalesce(F.expr("try_variant_get(s, '$.required', 'array<string>')"), F.array().cast("array<string>")).alias("required"),
        (~F.coalesce(F.expr("try_variant_get(s, '$.additionalProperties', 'boolean')"), F.lit(True))).alias("closed"),
        F.expr("transform(map_entries(coalesce(try_variant_get(s, '$.properties', 'map<string,variant>'), map())), e -> named_struct('k', e.key, 't', try_variant_get(e.value, '$.type', 'string'), 'e', transform(try_variant_get(e.value, '$.enum', 'array<variant>'), x -> to_json(x))))").alias("fields"),
    )
    held = calls.join(spec, "name", "left").withColumn("m", F.expr("try_variant_get(try_parse_json(arguments), '$', 'map<string,variant>')"))
    held = held.withColumn("given", F.expr("transform(map_entries(m), e -> named_struct('k', e.key, 't', schema_of_variant(e.value), 'j', to_json(e.value)))"))
    types = " ".join(f"WHEN '{k}' THEN g.t RLIKE '{p}'" for k, p in TYPES.items())
    problems = F.expr(
        "array_sort(array_distinct(concat("
        " IF(known IS NULL, array('unknown tool'), array()),"
        " IF(m IS NULL, array('arguments are no object'), array()),"
        " transform(filter(coalesce(required, array()), r -> NOT exists(coalesce(given, array()), g -> g.k = r)), r -> concat('missing ', r)),"
        " IF(coalesce(closed, false), transform(filter(coalesce(given, array()), g -> NOT exists(fields, f -> f.k = g.k)), g -> concat('unexpected ', g.k)), array()),"
        f" flatten(transform(coalesce(fields, array()), f -> transform(filter(coalesce(given, array()), g -> g.k = f.k AND NOT coalesce(CASE f.t {types} ELSE true END, true)), g -> concat('wrong type ', f.k)))),"
        " flatten(transform(coalesce(fields, array()), f -> transform(filter(coalesce(given, array()), g -> g.k = f.k AND f.e IS NOT NULL AND NOT array_contains(f.e, g.j)), g -> concat('not in enum ', f.k))))"
        ")))"
    )
    return held.withColumn("problems", problems).drop("known", "required", "closed", "fields", "m", "given")


def format_chats(messages: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """One row per message, call and result: conv_id, turn, level, pos, kind, call_id, status, json.

    Sorted by conv_id, turn, level, pos, call_id, kind, a conversation is in order: calls by their
    level, each result right behind its call. ``status`` is ok, or what is wrong: for calls
    ``no id``, ``repeated id`` (an earlier call has it), ``circular``, ``invalid`` (the JSON lists
    why) or ``no result``; for results ``repeated`` or ``no call``. Such rows stay. Defined cases:
    null role and text count as empty; null conversations and turns are values of their own and
    link nothing; JSON that does not parse is plain text; equal rows stay equal rows; other
    columns are ignored.
    """
    spark = messages.sparkSession
    stage = Stage(spark)
    calls, results, plain = extract(messages)
    calls, results = stage.cut(calls, "calls"), stage.cut(results, "results")
    text = plain.select(
        "conv_id", "turn", F.lit(0).alias("level"), F.lit(0).alias("pos"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"),
        F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )
    if tools is None:
        tools = empty(spark, "name string, parameters string")
    place = F.struct("turn", "pos", "name", "arguments")
    owner = calls.where("call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy(*_KEY).agg(F.min(place).alias("own"))
    levels = topological_levels(calls.where("conv_id IS NOT NULL"), stage)
    first = results.where("conv_id IS NOT NULL").groupBy(*_KEY).agg(F.min(F.struct("turn", "content")).alias("res"))
    held = validate(calls, tools).join(owner, _KEY, "left").join(levels, _KEY, "left").join(first.select(*_KEY, F.lit(True).alias("answered")), _KEY, "left")
    status = (
        F.when(F.col("call_id").isNull(), "no id")
        .when(F.coalesce(place != F.col("own"), F.lit(True)), "repeated id")
        .when(F.col("level").isNull(), "circular")
        .when(F.size("problems") > 0, "invalid")
        .when(F.col("answered").isNull(), "no result")
        .otherwise("ok")
    )
    quote = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(c).alias("x"))), r"^\{\"x\":|\}$", "")
    call_json = F.concat(
        F.lit('{"arguments":'), F.col("arguments"), F.lit(',"id":'), F.coalesce(F.when(F.col("call_id").isNotNull(), quote("call_id")), F.lit("null")),
        F.lit(',"name":'), quote("name"), F.lit(',"problems":'), F.to_json("problems"), F.lit(',"role":"assistant","type":"tool_call"}'),
    )
    call_rows = held.select("conv_id", "turn", F.coalesce("level", F.lit(2**31 - 1)).alias("level"), "pos", F.lit("call").alias("kind"), "call_id", status.alias("status"), call_json.alias("json"))
    at = owner.join(levels, _KEY, "left").select(*_KEY, F.col("own.turn").alias("at_turn"), F.coalesce("level", F.lit(2**31 - 1)).alias("at_level"), F.col("own.pos").alias("at_pos"))
    answers = results.join(first, _KEY, "left").join(at, _KEY, "left")
    res_status = F.when(F.col("at_turn").isNull() & F.col("at_pos").isNull(), "no call").when(F.struct("turn", "content") != F.col("res"), "repeated").otherwise("ok")
    linked = F.col("at_pos").isNotNull()
    res_json = F.concat(F.lit('{"content":'), F.col("content"), F.lit(',"id":'), quote("call_id"), F.lit(',"role":"tool"}'))
    result_rows = answers.select(
        "conv_id", F.when(linked, F.col("at_turn")).otherwise(F.col("turn")).alias("turn"), F.coalesce("at_level", F.lit(0)).alias("level"), F.coalesce("at_pos", F.lit(0)).alias("pos"),
        F.lit("result").alias("kind"), "call_id", res_status.alias("status"), res_json.alias("json"),
    )
    return text.unionByName(call_rows).unionByName(result_rows)
