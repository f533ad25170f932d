"""Tool-call linking with DataFrame and SQL functions only.

Calls and results meet in a hash join on their identifier.  Calls are put into topological
order by level: a call's level is one more than the highest of the calls that it depends on,
and a call that depends on itself through others has none.  Runs of calls with one dependency
each are followed by pointer doubling, so that a chain takes the logarithm of its length in
rounds; only calls that depend on several (joints) are settled one after the other.  Arguments are
checked against a schema table, parameter by parameter, and what is left is serialised
as canonical JSON: keys in order, no white space.

Repeated identifiers: of calls, and of results, the earliest turn counts (then the smallest text).  A
result without a call has status ``orphan``, a call without a result ``unanswered``.  Null
identifiers match nothing.  Arguments that aren't a JSON object are invalid, with the error
``not an object``; a dependency that doesn't exist is ignored for the order.  Null conversations
order among themselves; empty tables give an empty result; columns beside those named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteline.llm import store
from siteline.operators.ordinal import with_ordinal

#: What ``schema_of_variant`` says of a value, for each JSON schema type.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT.*$", "array": "^ARRAY.*$"}


def first_of(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row a key: the earliest turn, then the smallest of the other columns."""
    order = F.struct("turn", *columns)
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("o"), F.count("*").alias("n_copies")).select(key, "o.*", "n_copies")


def chains(single: DataFrame) -> DataFrame:
    """call_id, ptr and dist: for calls with one dependency each (call_id, needs), the first call up their chain that isn't one of them.

    Every round doubles what a pointer has passed.  Calls in or behind a cycle of such calls have
    no row: they are still on their way when every chain must have ended.
    """
    state = store.written(single.select("call_id", F.col("needs").alias("ptr"), F.lit(1).cast("long").alias("dist"), F.lit(False).alias("done")), "chains")
    left, rounds = state.count(), 0
    most = left.bit_length() + 1
    while left and rounds < most:
        passed = state.select(F.col("call_id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        moved = state.filter("not done").join(passed, "ptr", "left").select("call_id", F.coalesce("ptr2", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.coalesce("done2", F.lit(True)).alias("done"))
        state, last = store.written(state.filter("done").unionByName(moved), "chains"), state
        store.delete(last)
        left, rounds = state.filter("not done").count(), rounds + 1
    return state.filter("done").drop("done")


def joints(needs: DataFrame, base: DataFrame) -> DataFrame:
    """call_id and level of calls with several dependencies, as far as they can be settled.

    ``needs`` has (call_id, needs, away) among such calls; ``base`` (call_id, base) is what their other
    dependencies ask for, null if one of them has no level.  A round settles the calls
    all of whose dependencies are settled, reads what the round before wrote and appends to one table.
    """
    spark, path = needs.sparkSession, store.new_path(needs.sparkSession, "joints")
    schema = "call_id string, level long"
    waiting = store.written(needs.join(base, "call_id").filter("base is not null"), "waiting")
    free = base.filter("base is not null").join(needs, "call_id", "left_anti").select("call_id", F.col("base").alias("level"))
    fresh = store.written(free, "fresh")
    while True:
        fresh.write.mode("append").parquet(path)
        if fresh.isEmpty() or waiting.isEmpty():
            store.delete(waiting, fresh)
            return spark.read.schema(schema).parquet(path)
        near = waiting.join(fresh.select(F.col("call_id").alias("needs"), "level"), "needs", "left").withColumn("base", F.greatest("base", F.col("level") + F.col("away")))
        state = store.written(near.groupBy("call_id").agg(F.max("base").alias("base"), F.count(F.when(F.col("level").isNull(), 1)).alias("left")), "state")
        rest = near.filter("level is null").select("call_id", "needs", "away").join(state.filter("left > 0").select("call_id", "base"), "call_id")
        used = waiting, fresh, state
        waiting, fresh = store.written(rest, "waiting"), store.written(state.filter("left = 0").select("call_id", F.col("base").alias("level")), "fresh")
        store.delete(*used)


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """call_id and level of every call: 0 without dependencies; null in or behind a cycle.

    ``edges`` has (call_id, needs).
    """
    nodes = calls.select(F.col("call_id").cast("string")).dropna().distinct()
    known = edges.select(F.col("call_id").cast("string"), F.col("needs").cast("string")).dropna().distinct()
    known = known.join(nodes.withColumnRenamed("call_id", "needs"), "needs", "left_semi").join(nodes, "call_id", "left_semi")
    # a call's dependencies are counted before they are listed, so that no group is collected
    degree = known.groupBy("call_id").agg(F.count("*").alias("degree"), F.min("needs").alias("needs"))
    placed = store.written(nodes.join(degree, "call_id", "left"), "degrees")
    single = chains(placed.filter("degree = 1").select("call_id", "needs"))
    many = placed.filter("degree > 1").select("call_id")
    zero = F.lit(0).cast("long")
    tops = placed.filter("degree is null").select("call_id", zero.alias("level"))
    if not many.isEmpty():
        ends = single.select(F.col("call_id").alias("needs"), "ptr", "dist")
        kind = placed.select(F.col("call_id").alias("end"), F.coalesce("degree", F.lit(0)).alias("degree"))
        through = known.join(many, "call_id", "left_semi").join(ends, "needs", "left").select("call_id", F.coalesce("ptr", "needs").alias("end"), (F.coalesce("dist", zero) + 1).alias("away"))
        through = store.written(through.join(kind, "end"), "through")  # an end of degree 1 is in a cycle
        base = through.groupBy("call_id").agg(F.when(F.max(F.when(F.col("degree") == 1, 1)).isNull(), F.coalesce(F.max(F.when(F.col("degree") == 0, F.col("away"))), zero)).alias("base"))
        among = through.filter("degree > 1").groupBy("call_id", F.col("end").alias("needs")).agg(F.max("away").alias("away"))
        tops = tops.unionByName(joints(among, store.written(base, "base")))
    below = single.join(tops.select(F.col("call_id").alias("ptr"), "level"), "ptr").select("call_id", (F.col("level") + F.col("dist")).alias("level"))
    return store.written(placed.select("call_id").join(tops.unionByName(below), "call_id", "left"), "levels")


def numbered(df: DataFrame, group: str, *order: str, name: str) -> DataFrame:
    """``df`` numbered from 1 within ``group``, without a task for a group: all rows in one range sort, less what precedes the group."""
    whole = with_ordinal(df, group, *order, name="__place")
    first = whole.groupBy(F.col(group).alias("__group")).agg(F.min("__place").alias("__first"))
    return whole.join(first, F.col(group).eqNullSafe(F.col("__group"))).withColumn(name, F.col("__place") - F.col("__first") + 1).drop("__place", "__group", "__first")


def errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """call_id and the sorted list of what is wrong with its arguments, for calls with an error.

    ``schemas`` has (name, parameter, type, required); a tool that it doesn't hold has no rules.
    """
    parsed = calls.select("call_id", "name", F.expr("try_parse_json(arguments)").alias("v"))
    shaped = parsed.withColumn("object", F.coalesce(F.expr("schema_of_variant(v)").startswith("OBJECT"), F.lit(False)))
    pattern = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))[F.col("type")]
    rule = shaped.filter("object").join(schemas, "name").withColumn("kind", F.expr("schema_of_variant(element_at(cast(v as map<string, variant>), parameter))"))
    missing = F.when(F.col("required") & (F.col("kind").isNull() | (F.col("kind") == "VOID")), F.concat(F.lit("missing "), "parameter"))
    wrong = F.when(F.col("kind").isNotNull() & (F.col("kind") != "VOID") & ~F.coalesce(F.rlike(F.col("kind"), pattern), F.lit(True)), F.concat(F.lit("wrong type "), "parameter"))
    bad = rule.select("call_id", F.coalesce(missing, wrong).alias("error")).filter("error is not null")
    shape = shaped.filter("not object").select("call_id", F.lit("not an object").alias("error"))
    return bad.unionByName(shape).groupBy("call_id").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("errors"))


def link(calls: DataFrame, results: DataFrame, edges: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every call and every orphan result: linked, ordered, checked and serialised.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text); ``results``: conv_id,
    turn, call_id, content.  ``place`` numbers a conversation's calls in topological
    order, ties by turn and call_id; calls in cycles come last.
    """
    own = store.written(first_of(calls, "call_id", "conv_id", "name", "arguments").withColumn("call_id", F.col("call_id").cast("string")), "calls")
    back = first_of(results, "call_id", "conv_id", "content").select("call_id", F.col("turn").alias("result_turn"), F.col("conv_id").alias("result_conv"), "content")
    ranked = own.select("call_id", "conv_id", "turn").join(levels(own, edges), "call_id").withColumn("__last", F.col("level").isNull())
    placed = numbered(ranked, "conv_id", "__last", "level", "turn", "call_id", name="place").select("call_id", "level", "place")
    checked = own.join(placed, "call_id", "left").join(errors(own, schemas), "call_id", "left")
    joined = checked.hint("shuffle_hash").join(back, "call_id", "full")
    status = F.when(F.col("turn").isNull(), "orphan").when(F.col("result_turn").isNull(), "unanswered").otherwise("linked")
    canonical = F.to_json(F.struct(F.expr("try_parse_json(arguments)").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result")), {"ignoreNullFields": "false"})
    is_call = F.col("turn").isNotNull()
    return joined.select(
        F.coalesce("conv_id", "result_conv").alias("conv_id"), "call_id", "turn", "result_turn", status.alias("status"),
        F.col("level").cast("long").alias("level"), "place", F.when(is_call, F.col("errors").isNull()).alias("valid"), "errors",
        F.when(is_call, canonical).alias("json"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of ``conversations`` as calls of one tool, the turn after each as its result, each call needing the user turn before."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    users = turns.filter(known & (F.col("role") == "user"))
    calls = users.select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"))
    results = turns.filter(known & (F.col("role") == "assistant")).select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    placed = with_ordinal(users.select("conv_id", "turn").distinct(), "conv_id", "turn", name="n")
    before = placed.select("conv_id", F.col("turn").alias("before"), (F.col("n") + 1).alias("n"))
    edges = placed.join(before, ["n", "conv_id"]).select(name(F.col("turn")).alias("call_id"), name(F.col("before")).alias("needs"))
    schemas = spark.createDataFrame([("reply", "text", "string", True), ("reply", "turn", "integer", True)], "name string, parameter string, type string, required boolean")
    return link(calls, results, edges, schemas)


SQL = """
with calls as (
  select conv_id || ':' || turn as call_id, min(struct_pack(turn := turn, conv_id := conv_id, text := text)) as o
  from conversations where role = 'user' and conv_id is not null and turn is not null group by 1),
results as (
  select conv_id || ':' || (turn - 1) as call_id, min(struct_pack(turn := turn, conv_id := conv_id, text := text)) as o
  from conversations where role = 'assistant' and conv_id is not null and turn is not null group by 1),
placed as (
  select call_id, o.conv_id as conv_id, o.turn as turn, o.text as text,
         row_number() over (partition by o.conv_id order by o.turn, call_id) as place
  from calls)
select coalesce(p.conv_id, r.o.conv_id) as conv_id, coalesce(p.call_id, r.call_id) as call_id, p.turn as turn, r.o.turn as result_turn,
       case when p.call_id is null then 'orphan' when r.call_id is null then 'unanswered' else 'linked' end as status,
       p.place - 1 as level, p.place as place,
       case when p.call_id is not null then p.text is not null end as valid,
       case when p.call_id is not null and p.text is null then 'missing text' end as errors,
       case when p.call_id is not null then cast(to_json(struct_pack(
         arguments := case when p.text is null then to_json(struct_pack(turn := p.turn)) else to_json(struct_pack(text := p.text, turn := p.turn)) end,
         id := p.call_id, name := 'reply', result := r.o.text)) as varchar) end as json
from placed p full join results r on p.call_id = r.call_id
"""

QUERIES = {"op6_toolcall_linking": query}
ORACLE_SQL = {"op6_toolcall_linking": SQL}
