"""Queries of sources and sinks (written and read back), seeded functions and the remaining adapters and audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sessionloom.functions import seeded
from sessionloom.operators import adapters, benchmarks
from sessionloom.plans.runtime import scratch, table
from sessionloom.queries.part1 import EVENT_LIST, FIRST_SESSIONS, STRIP, _sessions, events
from sessionloom.sources import readers, writers

QUERIES: dict = {}
CONTENT = STRIP.format("ev->>'$.content'")
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


DOCS = "select doc_id, md5(coalesce(text, '~')) as digest, lang from documents"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang")


def _digest(df):
    return df.select("doc_id", F.md5(F.coalesce("text", F.lit("~"))).alias("digest"), "lang")


@query(DOCS)
def snk1_parquet_shards(spark, sf):
    path = scratch(spark, "shards")
    writers.write_shards(_docs(spark, sf), path, "doc_id")
    return _digest(spark.read.parquet(path))


@query(DOCS)
def snk2_json_shards(spark, sf):
    path = scratch(spark, "json")
    writers.write_shards(_docs(spark, sf), path, "doc_id", fmt="json")
    return _digest(spark.read.schema("doc_id long, text string, lang string").option("mode", "FAILFAST").json(path))


@query("select reason, source, source_record_id, detail from rejections")
def snk4_rejection_log(spark, sf):
    accepted, log = writers.split_rejections(table(spark, sf, "rejections").withColumnRenamed("reason", "reject"))
    return log


@query("select vec_id, label from embeddings")
def snk5_resumable_append(spark, sf):
    path = scratch(spark, "teacher")
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    writers.append_new(e.where("vec_id % 3 = 0"), path, "vec_id")
    writers.append_new(e, path, "vec_id")
    return spark.read.parquet(path)


@query("select item_id, user_query, correct_answer from eval_items")
def src5_csv(spark, sf):
    path = scratch(spark, "csv")
    table(spark, sf, "eval_items").select("item_id", "user_query", "correct_answer").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return readers.read_csv(spark, path, ["item_id", "user_query"])


@query("select 'documents' as name, count(*) as rows from documents union all select 'sessions', count(*) from sessions union all select 'probes', count(*) from probes")
def src3_parquet_counts(spark, sf):
    parts = [table(spark, sf, n).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in ("documents", "sessions", "probes")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select item_id, correct_answer as response, 1 as n from eval_items")
def src9_single_pairs(spark, sf):
    e = table(spark, sf, "eval_items").select("item_id", F.col("user_query").alias("prompt"), F.col("correct_answer").alias("response"))
    s = readers.samples(e)
    return s.select("item_id", F.element_at("responses", 1).alias("response"), F.size("prompts").alias("n"))


@query("select session_index, session_id from split_index where session_index in (0, 7, 123)")
def src10_random_access(spark, sf):
    return readers.rows_at(table(spark, sf, "split_index"), "session_index", [0, 7, 123]).select("session_index", "session_id")


def _named(spark, folder: str, suffix: str) -> list[str]:
    """The data files of a written text table under names with another suffix."""
    name = spark._jvm.org.apache.hadoop.fs.Path
    fs = name(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for path in readers.expand_paths(["part-*.txt"], folder, spark):
        fs.rename(name(path), name(path[: -len(".txt")] + suffix))
    return readers.expand_paths([f"**/*{suffix}"], folder, spark)


@query(DOCS)
def src1_json_lines(spark, sf):
    """Written as JSON lines, listed by a recursive pattern and read back."""
    path = scratch(spark, "lines")
    _docs(spark, sf).select(F.to_json(F.struct("doc_id", "text", "lang"), {"ignoreNullFields": "false"})).write.text(path)
    return _digest(readers.read_records(spark, _named(spark, path, ".jsonl"), "doc_id bigint, text string, lang string"))


@query("select item_id, passage, len(incorrect_answers)::bigint as n from eval_items")
def src2_json_array(spark, sf):
    """The fixed table of evaluation items as one JSON array."""
    path = scratch(spark, "array")
    e = table(spark, sf, "eval_items").select("item_id", "passage", "incorrect_answers")
    e.agg(F.to_json(F.collect_list(F.struct("*")))).write.text(path)
    rows = readers.read_records(spark, _named(spark, path, ".json"), "item_id string, passage string, incorrect_answers array<string>")
    return rows.select("item_id", "passage", F.size("incorrect_answers").cast("bigint").alias("n"))


@query("""select item_id as persona_id, 2::bigint as kept, 1 as dropped, case when item_id like '%7' then 'count' end as error from eval_items""")
def src6_histories(spark, sf):
    """One object a file: an empty message is dropped, a wrong total is told."""
    path = scratch(spark, "histories")
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    e = table(spark, sf, "eval_items")
    total = F.when(F.col("item_id").like("%7"), 9).otherwise(3)
    whole = F.to_json(F.struct(F.struct(F.col("item_id").alias("persona_id"), total.alias("total_messages")).alias("metadata"), F.array(said("user", F.col("user_query")), said("assistant", F.lit(" ")), said("assistant", F.col("correct_answer"))).alias("chat_history")))
    e.select("item_id", whole.alias("value")).repartition(1).write.partitionBy("item_id").text(path)
    return readers.read_histories(spark, [path]).select("persona_id", F.size("messages").cast("bigint").alias("kept"), "dropped", "error")


@query("select row_number() over (order by item_id) - 1 as position, user_query as question, correct_answer as answer from eval_items")
def src7_aligned_lists(spark, sf):
    """Two JSON arrays of the fixed table of evaluation items, joined by position."""
    e, paths = table(spark, sf, "eval_items"), {}
    for name, column in (("question", "user_query"), ("answer", "correct_answer")):
        paths[name] = scratch(spark, name)
        ordered = F.expr(f"transform(array_sort(collect_list(struct(item_id, {column}))), s -> s.{column})")
        e.agg(F.to_json(ordered)).write.text(paths[name])
    return readers.read_aligned_lists(spark, paths, "string")


@query(f"""with {FIRST_SESSIONS}, {EVENT_LIST}, m as (select session_id, ev->>'$.id' as event_id, {CONTENT} as c from x where coalesce(ev->>'$.type', 'message') = 'message' and {CONTENT} <> '')
select session_id, event_id, len(regexp_extract_all(c, '[\\pL\\pN_]+')) > 8 as cut from m""")
def st2_truncated_events(spark, sf):
    """Messages cut to eight words of content and the mark, where they have more."""
    from sessionloom.operators import segment

    @pandas_udf("boolean")
    def shortened(texts: pd.Series) -> pd.Series:
        event = {"type": "message", "role": "user", "id": "e", "name": "", "status": "", "arguments": None}
        fits = lambda e: segment.count_words(e["content"].removesuffix(segment.MARK)) <= 8
        made = [segment.truncate(event | {"content": t}, fits)["content"] if segment.count_words(t) > 8 else t for t in texts]
        return pd.Series([m != t and m.endswith(segment.MARK) and t.startswith(m.removesuffix(segment.MARK)) and segment.count_words(m.removesuffix(segment.MARK)) == 8 for m, t in zip(made, texts)])

    e = _sessions(spark, sf).select("session_id", F.explode("events").alias("e")).where("e.type = 'message' and e.content != ''")
    return e.select("session_id", F.col("e.id").alias("event_id"), shortened(F.col("e.content")).alias("cut"))


@query()
def build_pipeline(spark, sf):
    """The whole build over all sessions with their probes: rows and tokens of each table of the result."""
    from sessionloom.operators.canonical import PROBE
    from sessionloom.plans import pipeline

    struct = F.struct(
        F.col("probe_id").alias("id"), "prompt", "probe_type", "reference", F.lit("").alias("split"), F.lit(None).cast("string").alias("metadata"),
        "answerable", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence_event_ids"),
    )
    p = table(spark, sf, "probes").groupBy("session_id", "probe_index").agg(*[F.min(c).alias(c) for c in ("probe_id", "prompt", "probe_type", "reference", "answerable")], F.min("evidence_event_ids").alias("evidence"))
    own = p.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("probe_index", struct.alias("p")))), lambda s: s["p"].cast(PROBE)).alias("probes"))
    s = _sessions(spark, sf).withColumnRenamed("session_index", "position").join(own, "session_id", "left")
    s = s.withColumn("probes", F.coalesce("probes", F.array().cast("array<" + PROBE.simpleString() + ">")))
    config = pipeline.BuildConfig(target_tokens=100_000, shares={"coding": 0.2, "conversation": 0.35, "synthetic": 0.2, "tool": 0.25}, max_context_tokens=400, require_references=False)
    out = pipeline.build(s.select("position", "session_id", "source", "domain", "events", "probes"), config)
    kept = out["sessions"].groupBy("domain").agg(F.count("*").alias("rows"), F.sum("context_tokens").alias("tokens")).select(F.concat(F.lit("sessions:"), "domain").alias("part"), "rows", "tokens")
    lost = out["rejections"].groupBy("reason").agg(F.count("*").alias("rows")).select(F.concat(F.lit("rejected:"), "reason").alias("part"), "rows", F.lit(None).cast("bigint").alias("tokens"))
    split = out["probes"].groupBy("split").agg(F.count("*").alias("rows")).select(F.concat(F.lit("probes:"), "split").alias("part"), "rows", F.lit(None).cast("bigint").alias("tokens"))
    return kept.unionByName(lost).unionByName(split)


@query("select a.item_id, a.benchmark, b.lang from eval_items a join (select item_id, lang, persona_id from eval_items where persona_id is not null) b using (item_id)")
def src8_tasks_with_meta(spark, sf):
    e = table(spark, sf, "eval_items")
    tasks = e.select(F.lit("u").alias("user_id"), F.col("item_id").alias("task_id"), F.lit(1).alias("task_type"), "benchmark")
    meta = e.where("persona_id is not null").select(F.lit("u").alias("user_id"), F.col("item_id").alias("task_id"), F.lit(1).alias("task_type"), "lang")
    return readers.read_tasks(tasks, meta).select(F.col("task_id").alias("item_id"), "benchmark", "lang")


# ---- adapters -------------------------------------------------------------------------------------


@query(f"""with {FIRST_SESSIONS}, {EVENT_LIST}, g as (select session_id, count(*) as n, md5(string_agg((ev->>'$.id') || ':' || {CONTENT}, chr(10) order by pos)) as digest from x group by 1)
select 'src:' || session_id as session_id, coalesce(n, 0)::bigint as n, digest, case when n is null then 'no_events' end as reject, 'MIT' as license, session_id as record, 'false' as allowed, provenance_json->>'$.source_record_id' is not null as had from s left join g using (session_id)""")
def adp1_canonical(spark, sf):
    s = _sessions(spark, sf).select(F.col("session_id").alias("record_id"), "events", F.col("provenance_json").alias("provenance"))
    had = F.get_json_object("provenance", "$.source_record_id").isNotNull()
    a = adapters.adapt(s, "canonical", "src", "tool", {"license": " MIT "}).join(s.select(F.concat(F.lit("src:"), "record_id").alias("session_id"), had.alias("had")), "session_id")
    digest = F.when(F.size("events") > 0, F.md5(F.array_join(F.transform("events", lambda e: F.concat(e["id"], F.lit(":"), e["content"])), "\n")))
    said = lambda k: F.get_json_object("provenance", f"$.{k}")
    return a.select("session_id", F.size("events").cast("bigint").alias("n"), digest.alias("digest"), "reject", said("license").alias("license"), said("source_record_id").alias("record"), said("external_api_allowed").alias("allowed"), "had")


@query(f"with {FIRST_SESSIONS}, {EVENT_LIST} select session_id, count(*) as n, count_if({CONTENT} <> '') as slots, case when bool_or({CONTENT} = '') then 'empty_content' end as reject from x where ev->>'$.role' in ('user', 'assistant') and coalesce(ev->>'$.type', 'message') = 'message' group by 1")
def adp9_taskmaster(spark, sf):
    s = _sessions(spark, sf).where("events_json is not null")
    said = F.expr("transform(filter(events, e -> e.role in ('user', 'assistant') and e.type = 'message'), e -> named_struct('speaker', upper(e.role), 'text', e.content, 'segments', array(named_struct('text', e.content, 'annotations', array(named_struct('name', 'slot'))))))")
    a = adapters.taskmaster(s.select(F.col("session_id").alias("record_id"), said.alias("utterances")))
    return a.where(F.size("events") > 0).select(F.col("record_id").alias("session_id"), F.size("events").cast("bigint").alias("n"), F.size("memory_atoms").cast("bigint").alias("slots"), "reject")


STATE = '{"active_intent":"Find","service":"svc","slot_values":{"slot_name":["day","x"],"slot_value_list":[["mon","tue"],[]]}}'


@query(f"""with {FIRST_SESSIONS}, {EVENT_LIST}, m as (select session_id, pos, {CONTENT} as c, row_number() over (partition by session_id order by pos) - 1 as i from x where coalesce(ev->>'$.type', 'message') = 'message' and {CONTENT} <> '')
select session_id, 4 * count(*) as n, md5(string_agg('e' || 4 * i || ':' || c || chr(10) || 'e' || 4 * i + 1 || ':' || '{STATE}' || chr(10) || 'e' || 4 * i + 2 || ':{{"city":"Rome"}}' || chr(10) || 'e' || 4 * i + 3 || ':{{"id":' || i || '}}', chr(10) order by pos)) as digest,
md5(string_agg('svc.day=mon, tue@e' || 4 * i + 1 || chr(10) || 'svc.method=Go@e' || 4 * i + 2 || chr(10) || 'svc.id=' || i || '@e' || 4 * i + 3, chr(10) order by pos)) as facts from m group by 1""")
def adp8_schema_guided(spark, sf):
    """Each message of a session as a turn with a state in parallel lists, a call and a result."""
    s = _sessions(spark, sf).where("events_json is not null").withColumn("said", F.filter("events", lambda e: (e["type"] == "message") & (e["content"] != ""))).where("size(said) > 0")
    frame = """array(named_struct('service', 'svc', 'state', named_struct('active_intent', 'Find', 'slot_values', named_struct('slot_name', array('day', 'x'), 'slot_value_list', array(array('mon', 'tue'), cast(array() as array<string>)))),
        'service_call', array(named_struct('method', 'Go', 'parameters', map('city', 'Rome'))), 'service_results', array(named_struct('id', i))))"""
    turns = F.expr(f"transform(said, (e, i) -> named_struct('speaker', upper(e.role), 'utterance', e.content, 'frames', {frame}))")
    a = adapters.schema_guided_dialog(s.select("session_id", turns.alias("turns")))
    lines = F.array_join(F.transform("events", lambda e: F.concat(e["id"], F.lit(":"), F.coalesce(e["arguments"], e["content"]))), "\n")
    facts = F.array_join(F.transform("memory_atoms", lambda m: F.concat(m["key"], F.lit("="), m["value"], F.lit("@"), m["evidence_event_ids"][0])), "\n")
    return a.select("session_id", F.size("events").cast("bigint").alias("n"), F.md5(lines).alias("digest"), F.md5(facts).alias("facts"))


@query(f"""with p as (select probe_index, min(reference) r from probes group by 1), q as (select probe_index, {STRIP.format('r')} as r from p)
select probe_index, case when probe_index % 5 = 0 then 'bad_trajectory' when r = '' then 'empty_content' end as reject, case when probe_index % 5 = 0 then 0 else 4 end as n, case when probe_index % 5 <> 0 then '{{"k":' || probe_index || ',"z":1}}' end as arguments,
case when probe_index % 5 <> 0 and r <> '' then 'What result did the coding environment return for tool call ' || case when probe_index % 2 = 0 then 'c' || probe_index else 'e2' end || '?|' || {STRIP.format('substr(r, 1, 512)')} end as probe from q""")
def adp10_swe_zero(spark, sf):
    """Trajectories with calls in a JSON text under ``function``, every second without an id, and every fifth no JSON."""
    p = table(spark, sf, "probes").groupBy("probe_index").agg(F.min("reference").alias("r"))
    i, even = F.col("probe_index"), F.col("probe_index") % 2 == 0
    arguments = F.struct(F.lit(1).alias("z"), i.alias("k"))
    calls = F.to_json(F.array(F.struct(F.when(even, F.concat(F.lit("c"), i.cast("string"))).alias("id"), F.struct(F.lit("run").alias("name"), arguments.alias("arguments")).alias("function"))))
    none = F.lit(None).cast("string")
    said = lambda role, content, calls=none, id=none: F.struct(F.lit(role).alias("role"), content.alias("content"), calls.alias("tool_calls_json"), id.alias("tool_call_id"))
    made = F.to_json(F.array(said("system", F.lit("s")), said("user", F.lit("fix")), said("assistant", F.lit("so")), said("assistant", F.lit("thinking"), calls), said("tool", F.col("r"), id=F.when(even, F.concat(F.lit("c"), i.cast("string"))))))
    a = adapters.swe_zero(p.withColumn("trajectory", F.when(i % 5 == 0, "not json").otherwise(made)))
    asked = F.array_join(F.transform("probes", lambda q: F.concat(q["prompt"], F.lit("|"), q["reference"])), ";")
    return a.select("probe_index", "reject", F.size("events").alias("n"), F.get(F.col("events"), F.lit(2))["arguments"].alias("arguments"), F.nullif(asked, F.lit("")).alias("probe"))


@query("select session_index, len(probe_indices)::bigint as n, coalesce(list_sum([case when x % 2 = 0 then 1 else 0 end for x in probe_indices]), 0)::bigint as even from split_index")
def adp11_struct_of_lists(spark, sf):
    i = table(spark, sf, "split_index")
    z = i.withColumn("a", F.col("probe_indices")).withColumn("b", F.transform("probe_indices", lambda x: x % 2)).withColumn("z", F.arrays_zip("a", "b"))
    even = F.size(F.filter("z", lambda r: r["b"] == 0))
    return z.select("session_index", F.size("z").cast("bigint").alias("n"), even.cast("bigint").alias("even"))


@query("select event_id, session_id, case when arguments_json is null then null else json_extract_string(arguments_json, '$.limit') end as limit_value from (select session_id, event_id, min(arguments_json) arguments_json from session_events group by 1, 2)")
def adp12_literals(spark, sf):
    e = events(spark, sf).withColumn("a", seeded.literal_col(F.col("arguments_json")))
    return e.select("event_id", "session_id", F.get_json_object("a", "$.limit").alias("limit_value"))


@query(f"""with u as (select item_id, unnest(incorrect_answers) as v, generate_subscripts(incorrect_answers, 1) - 1 as i from eval_items), k as (select *, row_number() over (partition by item_id order by i) - 1 as n from u where {STRIP.format('v')} <> '')
select item_id, count(*) as atoms, string_agg('m' || n || ':slot' || i || '=' || {STRIP.format('v')} || '@e' || i || '?What value was provided for slot' || i || '?', chr(10) order by n) as facts from k group by 1""")
def adp13_grounded_items(spark, sf):
    e = table(spark, sf, "eval_items")
    names = F.transform("incorrect_answers", lambda x, i: F.concat(F.lit("slot"), i.cast("string")))
    evidence = F.transform("incorrect_answers", lambda x, i: F.array(F.concat(F.lit("e"), i.cast("string"))))
    atoms, made = adapters.grounded_items(names, F.col("incorrect_answers"), evidence, "slot", each=True)
    facts = F.array_join(F.zip_with(atoms, made, lambda m, p: F.concat(m["id"], F.lit(":"), m["key"], F.lit("="), m["value"], F.lit("@"), p["evidence_event_ids"][0], F.lit("?"), p["prompt"])), "\n")
    return e.select("item_id", F.size(atoms).cast("bigint").alias("atoms"), facts.alias("facts")).where("atoms > 0")


@query("select session_id, k as name, v as value from (select session_id, unnest(json_keys(c)) k, (c->>('$.' || unnest(json_keys(c))))::bigint as v from (select session_id, min(context_token_counts_json) c from sessions group by 1) where c is not null)")
def adp14_parallel_values(spark, sf):
    s = table(spark, sf, "sessions").groupBy("session_id").agg(F.min("context_token_counts_json").alias("c"))
    return s.select("session_id", F.explode(F.map_entries(F.from_json("c", "map<string,bigint>"))).alias("e")).select("session_id", F.col("e.key").alias("name"), F.col("e.value").alias("value"))


@query("select item_id, md5('user: ' || user_query || chr(10) || 'assistant: ' || correct_answer || chr(10) || 'user: ' || lang || chr(10) || 'assistant: ' || benchmark) as digest from eval_items")
def adp16_persona_turns(spark, sf):
    turn = lambda u, a: F.struct(F.col(u).alias("user"), F.col(a).alias("assistant"))
    turns = F.create_map(F.lit("1"), turn("lang", "benchmark"), F.lit("0"), turn("user_query", "correct_answer"))
    e = table(spark, sf, "eval_items").withColumn("m", adapters.persona_conversation(turns))
    return e.select("item_id", F.md5(adapters.session_text(F.col("m"))).alias("digest"))


@query("""with e as (select *, row_number() over (order by item_id) - 1 as source_row from eval_items), b as (select distinct persona_id from e where benchmark = 'persona' and persona_id is not null)
select item_id, len(incorrect_answers) + 1 as options, case when b.persona_id is not null then 'benchmark_persona_overlap' when source_row = 3 then 'pinned' when list_contains(incorrect_answers, correct_answer) then 'correct_answer_in_distractors' end as reject from e left join b using (persona_id) where benchmark <> 'persona'""")
def adp20_normalize_persona(spark, sf):
    from sessionloom.operators.indexing import dense_index

    e = dense_index(table(spark, sf, "eval_items"), ["item_id"], "source_row")
    n = benchmarks.normalize_persona(e.where("benchmark != 'persona'"), e.where("benchmark = 'persona'"), {3: "pinned"})
    return n.select("item_id", F.size("options").cast("bigint").alias("options"), "reject")


@query("select item_id, 'e0000' as first, case when length(trim(correct_answer)) > 0 then 'e0002' else 'e0000' end as last from eval_items")
def sup15_canonical_messages(spark, sf):
    said = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    m = F.array(said("user", F.col("user_query")), said("assistant", F.lit(" ")), said("assistant", F.col("correct_answer")))
    e = table(spark, sf, "eval_items").withColumn("e", benchmarks.canonical_messages(m))
    return e.select("item_id", F.col("e")[0]["id"].alias("first"), F.element_at("e", -1)["id"].alias("last"))


# ---- seeded and exact functions --------------------------------------------------------------------


@query()
def scl7_canonical_json(spark, sf):
    return table(spark, sf, "sessions").select("session_id", seeded.canonical_json_col(F.col("provenance_json")).alias("canonical"))


@query()
def scl8_canonical_arguments(spark, sf):
    return events(spark, sf).where("event_type = 'tool_call'").select("session_id", "event_id", seeded.canonical_arguments(F.col("arguments_json")).alias("arguments"))


@query()
def scl16_persona_option_order(spark, sf):
    e = table(spark, sf, "eval_items")
    return e.select("item_id", seeded.option_order(F.col("item_id"), F.size("incorrect_answers") + 1).alias("positions"))


@query()
def scl19_rollout_seed(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", seeded.rollout_seed(F.lit(42), F.col("label"), F.col("vec_id"), F.col("vec_id") % 2 == 0).alias("seed"))


# ---- audits ---------------------------------------------------------------------------------------


@query(f"with {FIRST_SESSIONS} select session_id, sha256(concat_ws(chr(0), session_id, source, coalesce(domain, ''), coalesce(events_json, ''))) as digest from s")
def sup4_base_digest(spark, sf):
    s = _sessions(spark, sf)
    return s.select("session_id", F.sha2(F.concat_ws("\0", "session_id", "source", F.coalesce("domain", F.lit("")), F.coalesce("events_json", F.lit(""))), 256).alias("digest"))


@query("select count(*) as latents, count(distinct label) as users, count(*) filter (len(embedding) <> 64) as wrong from embeddings")
def sup19_latent_audit(spark, sf):
    return table(spark, sf, "embeddings").agg(F.count("*").alias("latents"), F.count_distinct("label").alias("users"), F.count_if(F.size("embedding") != 64).alias("wrong"))


@query("select label, count(*) as n_sessions, round(avg(list_sum(embedding::double[])), 6) as mean_sum from embeddings group by 1")
def sup20_latent_table(spark, sf):
    path = scratch(spark, "latents")
    table(spark, sf, "embeddings").write.parquet(path)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n_sessions"), F.round(F.avg(total), 6).alias("mean_sum"))


@query("with t as (select distinct session_id, probe_index, probe_type from probes) select probe_type, count(*) as probes, count(distinct session_id) as sessions from t group by 1")
def agg1_probe_types(spark, sf):
    t = table(spark, sf, "probes").select("session_id", "probe_index", "probe_type").distinct()
    return t.groupBy("probe_type").agg(F.count("*").alias("probes"), F.count_distinct("session_id").alias("sessions"))


@query("select n, count(*) as sessions from (select session_id, count(distinct probe_index) n from probes group by 1) group by 1")
def agg1_probe_histogram(spark, sf):
    return table(spark, sf, "probes").select("session_id", "probe_index").distinct().groupBy("session_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("sessions"))
