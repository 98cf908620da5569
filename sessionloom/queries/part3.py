"""Queries of adapters, filters, segmentation, budgets, probes, sets and supporting audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.functions import text
from sessionloom.operators import adapters, benchmarks, budget, canonical, dedup, filters, indexing, probes, segment
from sessionloom.plans.runtime import table
from sessionloom.queries.part1 import DISTINCT_EVENTS, EVENT_LIST, FIRST_SESSIONS, HEX, NORM, PROBES, STRIP, WORDS, _hashed, _probes, _sessions, events

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


MESSAGE = "array<struct<role:string,content:string,name:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>>"


def _records(spark, sf):
    """Message records from the sessions' events: a call is an assistant message with one tool call."""
    s = _sessions(spark, sf).where("events_json is not null")
    null = "cast(null as string)"
    calls = "array(named_struct('id', cast(null as string), 'name', e.name, 'arguments', e.arguments))"
    expr = f"transform(events, e -> named_struct('role', case when e.type = 'tool_result' then 'tool' when e.type = 'tool_call' then 'assistant' else e.role end, 'content', e.content, 'name', e.name, 'tool_call_id', {null}, 'tool_calls', case when e.type = 'tool_call' then {calls} end))"
    return s.select(F.col("session_id").alias("record_id"), F.expr(expr).cast(MESSAGE).alias("messages"))


def _counted(df):
    """A comparable summary of adapted sessions."""
    e = F.col("events")
    return df.select(
        F.expr("substr(session_id, 3)").alias("session_id"),
        F.size(e).cast("bigint").alias("n"),
        F.size(F.filter(e, lambda x: x["type"] == "tool_call")).cast("bigint").alias("calls"),
        F.md5(F.array_join(F.transform(e, lambda x: F.concat(x["id"], F.lit(":"), x["content"])), "\n")).alias("digest"),
        F.size("probes").cast("bigint").alias("probes"),
        "reject",
    )


MSG = f"""with {FIRST_SESSIONS}, {EVENT_LIST},
m as (select session_id, pos, {STRIP.format("ev->>'$.content'")} c, {STRIP.format("ev->>'$.name'")} n, case when coalesce(ev->>'$.type', 'message') = 'tool_result' then 'tool' when coalesce(ev->>'$.type', 'message') = 'tool_call' then 'assistant' else ev->>'$.role' end as role, coalesce(ev->>'$.type', 'message') = 'tool_call' as call from x),
k as (select *, row_number() over (partition by session_id order by pos) - 1 as i, not call and role <> 'tool' and c = '' or role = 'tool' and c = '' as blank from m where role <> 'system')"""


@query(MSG + """ select session_id, count(*) as n, count_if(call) as calls, md5(string_agg('e' || i || ':' || case when call then '' else c end, chr(10) order by pos)) as digest, 0 as probes, case when bool_or(blank) then 'empty_content' end as reject from k group by 1""")
def adp4_messages(spark, sf):
    return _counted(adapters.adapt(_records(spark, sf), "messages", "m", "tool").withColumn("session_id", F.col("session_id")))


@query(MSG + """ select session_id, count(*) as n, count_if(call) as calls, md5(string_agg('e' || i || ':' || case when call then '' else c end, chr(10) order by pos)) as digest, count_if(role = 'tool' and c <> '') as probes, case when bool_or(blank) then 'empty_content' end as reject from k group by 1""")
def adp6_tool_messages(spark, sf):
    return _counted(adapters.adapt(_records(spark, sf), "tool_messages", "m", "tool"))


@query(MSG + """, calls as (select session_id, n, i, row_number() over (partition by session_id order by i) nth from k where call), results as (select session_id, i, row_number() over (partition by session_id order by i) nth from k where role = 'tool'),
bad as (select distinct x.session_id from results x left join calls y on y.session_id = x.session_id and y.nth = x.nth where y.i is null or y.i > x.i)
select x.session_id, x.i::bigint as "at", y.n as name from results x join calls y on y.session_id = x.session_id and y.nth = x.nth where x.session_id not in (select session_id from bad)""")
def adp5_result_pairing(spark, sf):
    """First in first out pairing; sessions where a result comes before its call are left to the mixed tests."""
    a = adapters.messages(_records(spark, sf).withColumn("messages", F.transform("messages", lambda m: F.when(m["role"] == "tool", m.withField("name", F.lit(""))).otherwise(m))))
    e = a.select(F.col("record_id").alias("session_id"), F.posexplode("events").alias("pos", "e"))
    open_calls = F.sum(F.when(F.col("e.type") == "tool_call", 1).when(F.col("e.type") == "tool_result", -1).otherwise(0)).over(Window.partitionBy("session_id").orderBy("pos"))
    rows = e.withColumn("open", open_calls)
    bad = rows.where("open < 0").select("session_id").distinct()
    return rows.join(bad, "session_id", "left_anti").where("e.type = 'tool_result'").select("session_id", F.col("pos").cast("bigint").alias("at"), F.col("e.name").alias("name"))


@query(f"""with {PROBES}, g as (select session_id, list(prompt order by probe_index) ps, list(reference order by probe_index) rs, min(probe_index) i from p group by 1), c as (select session_id, min(context) as context from sessions group by 1)
select session_id, len(ps)::bigint as n, md5(array_to_string([coalesce(regexp_replace(r, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g'), '') for r in rs], '|')) as digest, case when {STRIP.format('context')} = '' then 'empty_context' end as reject from g left join c using (session_id)""")
def adp2_fixed_trajectory(spark, sf):
    g = _probes(spark, sf).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("probe_index", "prompt", "reference"))).alias("g"))
    c = table(spark, sf, "sessions").groupBy("session_id").agg(F.min("context").alias("context"))
    d = g.join(c, "session_id", "left").select(F.col("session_id").alias("record_id"), "context", F.col("g.prompt").alias("prompts"), F.col("g.reference").alias("responses"))
    a = adapters.fixed_trajectory(d)
    refs = F.array_join(F.transform("probes", lambda p: p["reference"]), "|")
    return a.select(F.col("record_id").alias("session_id"), F.size("probes").cast("bigint").alias("n"), F.md5(refs).alias("digest"), "reject")


@query("""with w as (select session_index, ['t' || x for x in probe_indices] as ids from split_index)
select session_index, 't' || session_index as context, case when len(ids) > 2 then 1 else 0 end::bigint as n, case when len(ids) > 2 then array_to_string(ids[1:2], ' ') || '|' || array_to_string(ids[3:], ' ') else '' end as pair, case when len(ids) <= 2 then 'no_pairs' end as reject from w""")
def adp3_token_slices(spark, sf):
    i = table(spark, sf, "split_index").select(
        F.col("session_index").cast("string").alias("record_id"), "session_index", F.array("session_index").alias("ctx_ids"), F.array("probe_indices").alias("input_ids"),
        F.array(F.array(F.lit(2), F.lit(1 << 30))).alias("response_start_end"),
    )
    a = adapters.d2l_tokenized(i, lambda ids: " ".join(f"t{x}" for x in ids))
    pair = F.array_join(F.transform("probes", lambda p: F.concat(p["prompt"], F.lit("|"), p["reference"])), ";")
    return a.select("session_index", F.col("events")[0]["content"].alias("context"), F.size("probes").cast("bigint").alias("n"), pair.alias("pair"), "reject")


@query(MSG.replace("where role <> 'system'", "where true") + """ select session_id, count(*) as n, count(*) filter (role not in ('user', 'assistant')) as others from k where not call and role <> 'tool' group by 1""")
def adp7_sharegpt(spark, sf):
    s = _sessions(spark, sf).where("events_json is not null")
    conv = F.expr("transform(filter(events, e -> e.type not in ('tool_call', 'tool_result')), e -> named_struct('from', case e.role when 'user' then 'human' when 'assistant' then 'gpt' else e.role end, 'value', concat('x', e.content)))")
    d = s.select(F.col("session_id").alias("record_id"), conv.alias("conversations"))
    a = adapters.sharegpt(d.withColumn("conversations", F.expr("transform(conversations, c -> named_struct('from', case c.`from` when 'system' then 'environment' else c.`from` end, 'value', c.value))")))
    others = F.size(F.filter("events", lambda e: ~e["role"].isin("user", "assistant")))
    return a.where(F.size("events") > 0).select(F.col("record_id").alias("session_id"), F.size("events").cast("bigint").alias("n"), others.cast("bigint").alias("others"))


@query("select item_id, md5('user: ' || passage || chr(10) || 'assistant: ' || correct_answer || chr(10) || 'user: ' || user_query || chr(10) || 'assistant: ' || lang) as digest from eval_items")
def adp15_choice_conversation(spark, sf):
    c = adapters.choice_conversation(table(spark, sf, "eval_items"), ("passage", "correct_answer", "user_query", "lang"))
    return c.select("item_id", F.md5(adapters.session_text(F.col("messages"))).alias("digest"))


@query(f"""with {DISTINCT_EVENTS}, m as (select session_id, event_index, role, content, row_number() over (partition by session_id order by event_index) - 1 as i from e where event_type = 'message' and role in ('user', 'assistant')), g as (select session_id, i // 2 as k, max(case when i % 2 = 0 then role end) a, max(case when i % 2 = 1 then role end) b from m group by 1, 2)
select session_id, k, a = 'user' and b = 'assistant' as proper from g where b is not null""")
def adp17_noise_pairs(spark, sf):
    m = events(spark, sf).where("event_type = 'message' and role in ('user', 'assistant')")
    p = indexing.group_index(m.select("session_id", "event_index", "event_id", "role"), ["session_id"], ["event_index", "event_id"], "i").groupBy("session_id", F.expr("i div 2").alias("k"))
    g = p.agg(F.max(F.when(F.col("i") % 2 == 0, F.col("role"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("role"))).alias("b"))
    return g.where("b is not null").select("session_id", "k", ((F.col("a") == "user") & (F.col("b") == "assistant")).alias("proper"))


@query("select item_id, correct_answer || '|' || array_to_string(incorrect_answers, '|') as options from eval_items")
def adp18_option_parsing(spark, sf):
    e = table(spark, sf, "eval_items")
    lines = F.array_join(F.transform(F.concat(F.array("correct_answer"), F.col("incorrect_answers")), lambda o, i: F.concat(F.char(i + 65), F.lit(": "), o)), "\n")
    return e.select("item_id", F.array_join(text.options_from_text(lines), "|").alias("options"))


@query(f"with {FIRST_SESSIONS}, {EVENT_LIST} select session_id, md5(string_agg((ev->>'$.role') || ': ' || {STRIP.format("ev->>'$.content'")}, chr(10) order by pos)) as digest from x where coalesce(ev->>'$.type', 'message') = 'message' group by 1")
def adp19_session_text(spark, sf):
    s = _sessions(spark, sf).withColumn("m", F.filter("events", lambda e: e["type"] == "message")).where("size(m) > 0")
    return s.select("session_id", F.md5(adapters.session_text(F.col("m"))).alias("digest"))


@query("select a.item_id, f.form, a.benchmark, len(a.incorrect_answers) + 1 as options from eval_items a, (select unnest(['explicit', 'choice', 'persona']) as form) f")
def adp21_forms(spark, sf):
    e = table(spark, sf, "eval_items")
    forms = F.explode(F.array(*[F.lit(x) for x in ("explicit", "choice", "persona")])).alias("form")
    return e.select("item_id", forms, "benchmark", (F.size("incorrect_answers") + 1).alias("options"))


# ---- filters --------------------------------------------------------------------------------------


@query("select doc_id, case when lower(trim(coalesce(lang, ''))) not in ('en', 'de') then 'language' end as reason from documents")
def flt1_language(spark, sf):
    return table(spark, sf, "documents").select("doc_id", filters.language_reason(F.col("lang"), ["en", "DE"]).alias("reason"))


@query("select label_id, regexp_matches(j, '\"flagged\"\\s*:\\s*(true\\b|\\[[^\\]]*\\btrue\\b)') as flagged from (select label_id, '{\"a\": {\"flagged\": ' || case when flagged then '[false, true]' when label_id % 2 = 0 then '[false]' else 'false' end || '}}' as j from moderation_labels)")
def flt2_flagged_moderation(spark, sf):
    m = table(spark, sf, "moderation_labels")
    inner = F.when(F.col("flagged"), "[false, true]").when(F.col("label_id") % 2 == 0, "[false]").otherwise("false")
    return m.select("label_id", filters.flagged(F.concat(F.lit('{"a": {"flagged": '), inner, F.lit("}}"))).alias("flagged"))


@query("with b as (select distinct lower(regexp_replace(trim(source_record_id), '^/+|/+$', '', 'g')) as k from documents where domain is null) select doc_id, case when b.k is not null then 'excluded_repository' end as reject from documents left join b on b.k = lower(regexp_replace(trim(source_record_id), '^/+|/+$', '', 'g'))")
def flt3_repository(spark, sf):
    d = table(spark, sf, "documents")
    return filters.excluded(d.select("doc_id", "source_record_id"), F.col("source_record_id"), d.where("domain is null"), "source_record_id", "excluded_repository").select("doc_id", "reject")


@query("select session_id, case when w > 180 then 'words=' || w end as detail from (select session_id, min(cast(context_token_counts_json->>'$.words' as int)) w from sessions group by 1)")
def flt6_context_too_long(spark, sf):
    s = table(spark, sf, "sessions").groupBy("session_id").agg(F.min("context_token_counts_json").alias("c"))
    return s.select("session_id", filters.too_long(F.from_json("c", "map<string,int>"), 180).alias("detail"))


@query("select doc_id, case when domain is null or domain not in (select domain from source_catalog where domain <> 'synthetic') then 'unexpected_domain' end as reject from documents")
def flt7_unexpected_domain(spark, sf):
    c = table(spark, sf, "source_catalog").where("domain != 'synthetic'")
    return filters.unexpected_domain(table(spark, sf, "documents").select("doc_id", "domain"), c).select("doc_id", "reject")


@query("select item_id, case when persona_id in (select persona_id from eval_items where benchmark = 'persona' and persona_id is not null) and persona_id is not null then 'leakage' end as reject from eval_items where benchmark <> 'persona'")
def flt11_persona_leakage(spark, sf):
    e = table(spark, sf, "eval_items")
    return filters.leaked_groups(e.where("benchmark != 'persona'").select("item_id", "persona_id"), e.where("benchmark = 'persona'"), "persona_id").select("item_id", "reject")


@query("""with s as (select session_id, min(case when session_index % 3 = 0 then json_merge_patch(provenance_json, '{"external_api_allowed": true}') when session_index % 3 = 1 then json_merge_patch(provenance_json, '{"external_api_allowed": false}') else provenance_json end)::json as p from sessions group by 1)
select session_id, coalesce(lower(p->>'$.external_api_allowed') = 'true', false) as allowed, true as "local" from s""")
def flt12_provider_permission(spark, sf):
    """The tables' provenance never speaks of providers: every third session is told yes, every third no."""
    said = lambda v: F.concat(F.lit('{"external_api_allowed": ' + v + ", "), F.substring(F.trim("provenance_json"), 2, 1 << 30))
    p = F.when(F.col("session_index") % 3 == 0, said("true")).when(F.col("session_index") % 3 == 1, said("false")).otherwise(F.col("provenance_json"))
    s = table(spark, sf, "sessions").groupBy("session_id").agg(F.min(p).alias("p"))
    return s.select("session_id", filters.external_allowed(F.col("p"), "openai").alias("allowed"), filters.external_allowed(F.col("p"), "local").alias("local"))


@query("""with s as (select domain, count(*) sessions, sum(context_tokens)::double tokens, sum(probe_count)::double probes from sessions where domain is not null group by 1), t as (select sum(sessions)::double s, sum(tokens) t, sum(probes) p from s)
select 'sessions' as gate, round(s, 6) as value, 500000.0::double as bound from t where s < 500000 union all select 'mean_probes', round(p / s, 6), 10.0 from t where p / s < 10 union all
select 'share:' || domain, round(abs(tokens / t - case domain when 'conversation' then 0.35 when 'tool' then 0.25 when 'coding' then 0.2 else 0.2 end), 6), 0.03 from s, t where abs(tokens / t - case domain when 'conversation' then 0.35 when 'tool' then 0.25 when 'coding' then 0.2 else 0.2 end) > 0.03""")
def flt13_launch_gates(spark, sf):
    s = table(spark, sf, "sessions").where("domain is not null").groupBy("domain").agg(F.count("*").alias("sessions"), F.sum("context_tokens").alias("tokens"), F.sum("probe_count").alias("probes"))
    g = filters.gates(s, {"sessions": 500000, "mean_probes": 10}, {"conversation": 0.35, "tool": 0.25, "coding": 0.2, "synthetic": 0.2}, 0.03)
    return g.select("gate", F.round("value", 6).alias("value"), "bound")


# ---- segmentation and budget ----------------------------------------------------------------------


@query()
def st1_segments(spark, sf):
    return segment.segment_sessions(_sessions(spark, sf), 120)


@query(f"with {FIRST_SESSIONS} select session_id, len(from_json(events_json, '[\"json\"]'))::bigint as events, len(from_json(events_json, '[\"json\"]'))::bigint as covered from s where events_json is not null")
def st4_coverage(spark, sf):
    s = _sessions(spark, sf).where("events_json is not null")
    return segment.coverage(s, segment.segment_sessions(s, 120))


@query(f"""with w as (select doc_id, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\pL\\pN_]+') ws from documents), p as (select doc_id, ws, unnest(range(0, (len(ws) + 199) // 200)) as part from w where len(ws) > 0)
select doc_id, part::int as part, md5(array_to_string(ws[part * 200 + 1:part * 200 + 200], ' ')) as digest, len(ws[part * 200 + 1:part * 200 + 200])::bigint as words from p""")
def st3_split_words(spark, sf):
    d = segment.split_words(table(spark, sf, "documents"), "doc_id", "text", 200)
    return d.select("doc_id", "part", F.md5("text").alias("digest"), "words")


CAPS = {"coding": 6000, "conversation": 25000, "synthetic": 3000, "tool": 9000}


@query("""with recursive s as (select *, row_number() over (partition by domain order by session_index) r from (select session_index, min(domain) as domain, min(context_tokens)::bigint t from sessions where events_json is not null and domain is not null group by 1)),
c as (select unnest(['coding', 'conversation', 'synthetic', 'tool']) as domain, unnest([6000, 25000, 3000, 9000]) cap),
g as (select domain, 0::bigint as r, 0::bigint as used, -1::bigint as idx, false as ok from c union all
select g.domain, s.r, case when g.used + s.t <= c.cap then g.used + s.t else g.used end, s.session_index, g.used + s.t <= c.cap from g join c using (domain) join s on s.domain = g.domain and s.r = g.r + 1)
select idx as session_index from g where ok""")
def st6_greedy_budget(spark, sf):
    s = table(spark, sf, "sessions").where("events_json is not null and domain is not null")
    one = s.groupBy("session_index").agg(F.min("domain").alias("domain"), F.min("context_tokens").alias("t"))
    return budget.greedy(one, CAPS, "domain", "session_index", "t")


@query()
def st6_accept_sessions(spark, sf):
    """Budget and deduplication together, with rejection reasons."""
    s = _sessions(spark, sf).where("events_json is not null and domain is not null")
    t = text.normalize_exact(canonical.dedup_text(F.col("events")))
    h = s.select("session_index", "domain", F.col("context_tokens").alias("t"), t.alias("text"))
    rows = h.select("session_index", "domain", "t", F.sha2("text", 256).alias("h"), text.simhash64()(F.col("text")).alias("sim"), F.size(F.split("text", " ")).alias("w"))
    return budget.accept(rows, CAPS, "session_index", "domain", "t", "h", "sim", "w")


@query("select unnest(['coding', 'conversation', 'synthetic', 'tool']) as domain, unnest([110000000, 192500000, 110000000, 137500000])::bigint as cap")
def st7_domain_caps(spark, sf):
    c = budget.caps(550_000_000, {"conversation": 0.35, "tool": 0.25, "coding": 0.2, "synthetic": 0.2})
    return spark.createDataFrame(list(c.items()), "domain string, cap bigint")


# ---- probes ---------------------------------------------------------------------------------------


@query(f"""with {PROBES}, k as (select *, sha256(concat_ws(chr(0), session_id, probe_id)) as k from p), f as (select *, row_number() over (partition by session_id, probe_type order by k) = 1 as first from k),
o as (select *, row_number() over (partition by session_id order by first desc, case when first then probe_type end, k) r from f) select probe_index, session_id from o where r <= 3""")
def win5_select_target(spark, sf):
    return probes.select_target(_probes(spark, sf), 3).select("probe_index", "session_id")


CUT = lambda x: STRIP.format("substr(" + STRIP.format(x) + ", 1, 512)")
FOLD = lambda x: "lower(upper(replace(" + STRIP.format(x) + ", 'ß', 'ss')))"
STEPS = f"{DISTINCT_EVENTS}, i as (select *, row_number() over (partition by session_id order by event_index, event_id) as step from e)"
FRESH = lambda prefix, target, room, order: f"""k as (select distinct session_id, {FOLD('prompt')} kp, {FOLD('reference')} kr from p), h as (select session_id, count(*) have, list(try_cast(regexp_extract(probe_id, '^{prefix}(0|[1-9][0-9]*)$', 1) as bigint)) used from p group by 1),
n as (select *, row_number() over (partition by session_id, {FOLD('prompt')}, {FOLD('reference')} order by {order}) d from c where prompt <> '' and reference <> '' and not exists (select 1 from k where k.session_id = c.session_id and kp = {FOLD('c.prompt')} and kr = {FOLD('c.reference')})),
r as (select *, row_number() over (partition by session_id order by {order}) as rank from n where d = 1)
select session_id, rank, '{prefix}' || list_filter(range(0, {2 * target}), lambda x: not list_contains(coalesce(used, []), x))[rank] as probe_id, probe_type, md5(concat_ws('|', prompt, reference, array_to_string(ev, ','))) as digest from r left join h using (session_id) where rank <= {room}"""  # noqa: E731


def _made(df):
    digest = F.md5(F.concat_ws("|", "prompt", "reference", F.array_join("evidence_event_ids", ",")))
    return df.select("session_id", F.col("rank").cast("bigint").alias("rank"), "probe_id", "probe_type", digest.alias("digest"))


@query(f"""with {PROBES}, {STEPS}, c as (select b.session_id, b.step, case when b.role = 'assistant' and a.role = 'user' then {CUT('a.content')} else {CUT("'What result did the ' || coalesce(nullif(" + STRIP.format('b.tool_name') + ", ''), nullif(" + STRIP.format('a.tool_name') + ", ''), 'tool') || ' tool return at step ' || b.step || '?'")} end as prompt, {CUT('b.content')} as reference,
case when b.role = 'assistant' and a.role = 'user' then 'source_turn_response' else 'source_tool_result' end as probe_type, [a.event_id, b.event_id] as ev from i b join i a on a.session_id = b.session_id and a.step = b.step - 1 where b.role = 'assistant' and a.role = 'user' or b.event_type = 'tool_result' and a.event_type = 'tool_call'), """ + FRESH("s_p", 6, "least(6 - coalesce(have, 0), 4)", "step"))
def st10_seed_probes(spark, sf):
    return _made(probes.seed(events(spark, sf), _probes(spark, sf), 6, 4))


TEMPLATES = ", ".join("'" + t + "'" for t in probes.TEMPLATES)


@query(f"""with {PROBES}, {STEPS}, t as (select b.session_id, -1 as template, b.step, {STRIP.format("substr(a.content, 1, 512)")} as prompt, {CUT('b.content')} as reference, 'fallback_turn_response' as probe_type, [a.event_id, b.event_id] as ev from i b join i a on a.session_id = b.session_id and a.step = b.step - 1 where b.role = 'assistant' and a.role = 'user'),
g as (select session_id, step, event_id, coalesce(nullif({STRIP.format('content')}, ''), nullif({STRIP.format('arguments_json')}, ''), case when event_type = 'tool_call' then 'Called ' || coalesce(tool_name, '') || '.' end) as told from i),
q as (select session_id, step, event_id, told, unnest([{TEMPLATES}]) as question, unnest(range(0, 10)) as template from g where told is not null),
c as (select * from t union all select session_id, template, step, replace(question, '{{step}}', step::varchar), {CUT('told')}, 'fallback_event_recall', [event_id] from q), """ + FRESH("g_p", 6, "6 - coalesce(have, 0)", "template, step"))
def st11_fallback_probes(spark, sf):
    return _made(probes.fallback(events(spark, sf), _probes(spark, sf), 6))


@query(f"with {PROBES}, d as (select session_id, min(probe_index) as probe_index from p group by session_id, lower(trim(prompt, ' ')), lower(trim(coalesce(reference, ''), ' '))) select probe_index, session_id from d")
def set4_distinct_probes(spark, sf):
    return probes.distinct_probes(_probes(spark, sf), "session_id", "probe_index").select("probe_index", "session_id")


@query(f"with {PROBES} select session_id, count(*) = 3 as exact, greatest(10 - count(*), 0) as missing from p group by 1")
def sup6_probe_target(spark, sf):
    return _probes(spark, sf).groupBy("session_id").agg((F.count("*") == 3).alias("exact"), F.greatest(F.lit(10) - F.count("*"), F.lit(0)).alias("missing"))


@query(f"with {PROBES} select session_id, md5('Write ' || greatest(10 - count(*), 0) || ' grounded questions with answers about this session.' || chr(10) || session_id) as digest from p group by 1")
def sup7_generation_prompt(spark, sf):
    g = _probes(spark, sf).groupBy("session_id").agg(F.count("*").alias("n"))
    return g.select("session_id", F.md5(probes.generation_prompt(F.col("n"), 10, F.col("session_id"))).alias("digest"))


@query("select item_id, benchmark, row_number() over (order by item_id, benchmark) - 1 as position from eval_items")
def srt2_sorted_results(spark, sf):
    return benchmarks.sorted_results(table(spark, sf, "eval_items").select("item_id", "benchmark"), "item_id")


@query("with t as (select distinct domain as d from documents where domain is not null order by sha256(concat_ws(chr(0), '7', domain)), domain limit 2) select doc_id, case when d is null then 'train' else 'test' end as part from documents left join t on d = domain")
def set3_topic_split(spark, sf):
    return benchmarks.topic_split(table(spark, sf, "documents").select("doc_id", "domain"), "domain", 7, 2).select("doc_id", "part")


@query("select doc_id, case when regexp_replace(lower(regexp_replace(source, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), '[\\s\\pZ_-]+', '_', 'g') in ('lantern_talk', 'toolsmith_sft') then 'excluded_source' end as reject from documents")
def flt4_excluded_sources(spark, sf):
    return table(spark, sf, "documents").select("doc_id", filters.excluded_source(F.col("source"), ["Lantern-Talk", "toolsmith sft"]).alias("reject"))


# ---- sets, sorts and supporting audits -------------------------------------------------------------


@query("select benchmark, item_id from eval_items order by item_id limit 20")
def srt1_first_n(spark, sf):
    return table(spark, sf, "eval_items").orderBy("item_id").limit(20).select("benchmark", "item_id")


@query("with s as (select session_id, min(session_index) i, max(context_token_max) t from sessions group by 1) select session_id, t::bigint as tokens from s order by t desc nulls last, i limit 25")
def snk6_longest_subset(spark, sf):
    s = table(spark, sf, "sessions").groupBy("session_id").agg(F.min("session_index").alias("i"), F.max("context_token_max").cast("bigint").alias("tokens"))
    return s.orderBy(F.desc_nulls_last("tokens"), "i").limit(25).select("session_id", "tokens")


@query("select distinct persona_id from eval_items where persona_id is not null except select persona_id from eval_items where benchmark = 'persona'")
def set2_user_split(spark, sf):
    e = table(spark, sf, "eval_items")
    return e.where("persona_id is not null").select("persona_id").distinct().subtract(e.where("benchmark = 'persona'").select("persona_id"))


@query("select lang, count(*) as n from (select distinct lang, benchmark from eval_items) group by 1")
def set5_distinct_assets(spark, sf):
    return table(spark, sf, "eval_items").select("lang", "benchmark").distinct().groupBy("lang").agg(F.count("*").alias("n"))


@query("select source, bool_or(part = 1) as completed, bool_or(part = 2) as remaining, count(distinct part) > 1 as overlap from (select source, 1 as part from source_catalog where domain <> 'tool' union all select source, 2 from source_catalog where domain in ('tool', 'coding')) group by 1")
def set6_source_partition(spark, sf):
    c = table(spark, sf, "source_catalog")
    both = c.where("domain != 'tool'").select("source", F.lit(1).alias("part")).unionByName(c.where("domain in ('tool', 'coding')").select("source", F.lit(2).alias("part")))
    return both.groupBy("source").agg(F.bool_or(F.col("part") == 1).alias("completed"), F.bool_or(F.col("part") == 2).alias("remaining"), (F.count_distinct("part") > 1).alias("overlap"))


@query("select store, count(*) as n from (select 'sessions' as store, session_id as id from sessions union all select 'probes', session_id from probes) group by 1")
def set1_union_all(spark, sf):
    a = table(spark, sf, "sessions").select(F.lit("sessions").alias("store"), F.col("session_id").alias("id"))
    b = table(spark, sf, "probes").select(F.lit("probes").alias("store"), F.col("session_id").alias("id"))
    return a.unionByName(b).groupBy("store").agg(F.count("*").alias("n"))


DIGEST = "substr(sha256(concat_ws(chr(0), source, coalesce(domain, ''), coalesce(context, ''), coalesce(events_json, ''))), 1, 12)"


@query(f"with d as (select session_id, session_index, {DIGEST} as digest, count(*) over (partition by session_id) n, row_number() over (partition by session_id order by session_index, {DIGEST}) as occurrence from sessions) select case when n > 1 then session_id || ':collision-' || lpad(occurrence::varchar, 3, '0') || '-' || digest else session_id end as session_id, session_id as original, occurrence from d")
def win6_collision_repair(spark, sf):
    s = table(spark, sf, "sessions")
    d = F.substring(F.sha2(F.concat_ws("\0", "source", F.coalesce("domain", F.lit("")), F.coalesce("context", F.lit("")), F.coalesce("events_json", F.lit(""))), 256), 1, 12)
    rows = s.select(F.col("session_id").alias("original"), "session_index", d.alias("digest"))
    w = Window.partitionBy("original")
    o = rows.withColumn("n", F.count("*").over(w)).withColumn("occurrence", F.row_number().over(w.orderBy("session_index", "digest")).cast("bigint"))
    new = F.concat("original", F.lit(":collision-"), F.lpad(F.col("occurrence").cast("string"), 3, "0"), F.lit("-"), "digest")
    return o.select(F.when(F.col("n") > 1, new).otherwise(F.col("original")).alias("session_id"), "original", "occurrence")


CONTENT_FIELDS = ("source", "domain", "events_json", "memory_atoms_json", "provenance_json", "metadata_json")


@query(f"with {FIRST_SESSIONS} select session_id, sha256(concat_ws(chr(0), " + ", ".join(f"'{c}=' || coalesce({c}, '~')" for c in CONTENT_FIELDS) + ")) as digest from s")
def sup1_content_digest(spark, sf):
    """All that a session says: every column but its id and positions and what is derived from the rest."""
    s = canonical.first_rows(table(spark, sf, "sessions"), ["session_id"], ["session_index", "events_json"])
    return s.select("session_id", canonical.content_digest(CONTENT_FIELDS).alias("digest"))


@query("select session_id, count(*) as n from sessions group by 1 having count(*) > 1 order by session_id limit 10")
def sup2_duplicate_examples(spark, sf):
    return table(spark, sf, "sessions").groupBy("session_id").agg(F.count("*").alias("n")).where("n > 1").orderBy("session_id").limit(10)


@query("select distinct p.session_id from probes p where not exists (select 1 from sessions s where s.session_id = p.session_id and s.domain is not null)")
def sup3_stale_rows(spark, sf):
    keep = table(spark, sf, "sessions").where("domain is not null").select("session_id")
    return table(spark, sf, "probes").select("session_id").distinct().join(keep, "session_id", "left_anti")


@query("select session_id, (c->>'$.words')::int = t as primary_ok, (c->>'$.words')::int <= m as max_ok, coalesce((c->>'$.words')::int > 2048, false) as over from (select session_id, min(context_token_counts_json) c, min(context_tokens) t, min(context_token_max) m from sessions group by 1)")
def sup5_token_count_audit(spark, sf):
    s = table(spark, sf, "sessions").groupBy("session_id").agg(F.from_json(F.min("context_token_counts_json"), "map<string,int>").alias("c"), F.min("context_tokens").alias("t"), F.min("context_token_max").alias("m"))
    most = F.array_max(F.map_values("c"))
    return s.select("session_id", (F.col("c")["words"] == F.col("t")).alias("primary_ok"), (most <= F.col("m")).alias("max_ok"), F.coalesce(most > 2048, F.lit(False)).alias("over"))


@query("select session_index, array_to_string(probe_indices[:2], ',') as head, len(probe_indices) < 2 as short from split_index")
def sup8_stored_prefix(spark, sf):
    return table(spark, sf, "split_index").select("session_index", F.array_join(F.slice("probe_indices", 1, 2).cast("array<string>"), ",").alias("head"), (F.size("probe_indices") < 2).alias("short"))


@query("select item_id, len(list_distinct(incorrect_answers)) = len(incorrect_answers) as distinct_answers, trunc(cast((len(incorrect_answers) * 10.7)::varchar as double))::int as n from eval_items")
def sup16_answer_checks(spark, sf):
    a = F.col("incorrect_answers")
    return table(spark, sf, "eval_items").select("item_id", (F.size(F.array_distinct(a)) == F.size(a)).alias("distinct_answers"), (F.size(a) * 10.7).cast("string").cast("double").cast("int").alias("n"))


@query("select benchmark, count(*) as rows, count(distinct item_id) as ids, count(*) = count(distinct item_id) as unique_ids from eval_items group by 1")
def sup17_cardinality(spark, sf):
    return table(spark, sf, "eval_items").groupBy("benchmark").agg(F.count("*").alias("rows"), F.count_distinct("item_id").alias("ids"), (F.count("*") == F.count_distinct("item_id")).alias("unique_ids"))


@query("select item_id, dense_rank() over (order by persona_id) - 1 as user_id from eval_items where persona_id is not null")
def sup18_user_ids(spark, sf):
    from sessionloom.operators.indexing import dense_index

    e = table(spark, sf, "eval_items").where("persona_id is not null")
    ids = dense_index(e.select("persona_id").distinct(), ["persona_id"], "user_id")
    return e.join(ids, "persona_id").select("item_id", "user_id")


@query("with u as (select distinct benchmark as fold from eval_items) select item_id, fold, case when benchmark = fold then 'test' else 'train' end as part from eval_items, u")
def sup21_folds(spark, sf):
    return benchmarks.folds(table(spark, sf, "eval_items").select("item_id", "benchmark"), "benchmark").select("item_id", "fold", "part")


@query("with r as (select vec_id, label, row_number() over (partition by label order by vec_id desc) r from embeddings) select vec_id, label from r where r <= 3")
def sup23_retention(spark, sf):
    w = Window.partitionBy("label").orderBy(F.desc("vec_id"))
    return table(spark, sf, "embeddings").select("vec_id", "label", F.row_number().over(w).alias("r")).where("r <= 3").drop("r")


@query("with n as (select row_number() over (order by doc_id) - 1 as pos from documents where lang = 'en'), t as (select unnest([10, 70, 300]) as turns), a as (select turns, count(*) filter (pos < turns) as available from t, n group by 1) select item_id, turns, available from eval_items, a")
def jn9_prefix_expansion(spark, sf):
    from sessionloom.operators.indexing import dense_index

    noise = dense_index(table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), ["doc_id"], "pos")
    return benchmarks.prefixes(table(spark, sf, "eval_items").select("item_id"), noise, (10, 70, 300), "pos").select("item_id", "turns", "available")


@query("with m as (select item_id from eval_items where persona_id is not null) select benchmark, lang, count(*) filter (m.item_id is null) as missing, count(*) as n from eval_items t left join m using (item_id) group by 1, 2")
def jn10_missing_meta(spark, sf):
    e = table(spark, sf, "eval_items")
    m = e.where("persona_id is not null").select("item_id", F.lit(1).alias("has"))
    return e.join(m, "item_id", "left").groupBy("benchmark", "lang").agg(F.count_if(F.col("has").isNull()).alias("missing"), F.count("*").alias("n"))


@query("with p as (select item_id, length(correct_answer) % 4 as pred from eval_items where persona_id is not null) select e.item_id, case when p.item_id is null then 'missing' when p.pred <> length(e.user_query) % 4 then 'wrong' else 'right' end as status from eval_items e left join p using (item_id)")
def jn7_predictions(spark, sf):
    e = table(spark, sf, "eval_items")
    p = e.where("persona_id is not null").select("item_id", (F.length("correct_answer") % 4).alias("pred"))
    j = e.join(p, "item_id", "left")
    return j.select("item_id", F.when(F.col("pred").isNull(), "missing").when(F.col("pred") != F.length("user_query") % 4, "wrong").otherwise("right").alias("status"))
