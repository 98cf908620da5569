"""Queries of the text functions, canonical sessions, deduplication, splits, joins and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import names, text
from sessionloom.operators import canonical, dedup, indexing, splits, store
from sessionloom.plans.runtime import table
from sessionloom.queries import exact

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


EXACT = exact.tables() + ", " + exact.normalized("nx", "documents", "doc_id", "text")
NORM = "array_to_string(regexp_extract_all(replace(lower(coalesce({0}, '')), 'ß', 'ss'), '[\\pL\\pN_]+'), ' ')"
WORDS = "len(regexp_extract_all(replace(lower(coalesce({0}, '')), 'ß', 'ss'), '[\\pL\\pN_]+'))"
STRIP = "coalesce(regexp_replace({0}, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g'), '')"
DISTINCT_EVENTS = """e as (select session_id, event_id, min(event_index) event_index, min(role) as role, min(event_type) event_type,
 min(content) as content, min(tool_name) tool_name, min(arguments_json) arguments_json, min(status) status from session_events group by 1, 2)"""
FIRST_SESSIONS = "s as (select * from (select *, row_number() over (partition by session_id order by session_index nulls first, events_json nulls first) rn from sessions) where rn = 1)"
FRACTION = "cast(('0x' || substr(sha256(concat_ws(chr(0), '{0}', {1})), 1, 16)) as ubigint)::double / 18446744073709551616.0"
HEX = "substr(sha256(concat_ws(chr(0), '{0}', {1})), 1, 16)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct events: deliveries of one (session_id, event_id) count once."""
    cols = ["event_index", "role", "event_type", "content", "tool_name", "arguments_json", "status"]
    return table(spark, sf, "session_events").groupBy("session_id", "event_id").agg(*[F.min(c).alias(c) for c in cols])


# ---- text functions -------------------------------------------------------------------------------


@query(f"with {EXACT} select doc_id, sha256({exact.joined('t')}) as text_hash, len({exact.words('t')})::bigint as words from nx")
def scl1_normalize_hash(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.normalize_exact(F.col("text")).alias("t"))
    return d.select("doc_id", F.sha2("t", 256).alias("text_hash"), text.normalized_words(F.col("t")).alias("words"))


@query(f"with {EXACT} select doc_id, sha256({exact.joined('t')}) as text_hash from nx")
def scl2_exact_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.text_hash(F.col("text")).alias("text_hash"))


@query()
def scl3_simhash(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.normalize_exact(F.col("text")).alias("t"))
    return docs.select("doc_id", text.simhash64()(F.col("t")).alias("simhash"))


@query("select vec_id, bit_count(xor(hash_a, hash_b))::bigint as bits from (select vec_id, (vec_id * 2654435761)::bigint hash_a, (vec_id * 40503 + 12345)::bigint hash_b from embeddings)")
def scl4_hamming(spark, sf):
    e = table(spark, sf, "embeddings")
    a, b = (F.col("vec_id") * 2654435761).cast("bigint"), (F.col("vec_id") * 40503 + 12345).cast("bigint")
    return e.select("vec_id", text.hamming(a, b).cast("bigint").alias("bits"))


@query("select doc_id, b.band::bigint as band, ((doc_id * 2862933555777941 + 3037000493) >> (16 * b.band)) & 65535 as value from documents, (select unnest([0, 1, 2, 3])::bigint as band) b")
def scl5_bands(spark, sf):
    h = text.wrapped_product(F.col("doc_id"), 2862933555777941, 3037000493)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.bands(h)).alias("band", "value")).withColumn("band", F.col("band").cast("bigint"))


@query(f"select session_id, round({FRACTION.format(42, 'session_id')}, 12) as fraction from (select distinct session_id from sessions)")
def scl6_stable_fraction(spark, sf):
    s = table(spark, sf, "sessions").select("session_id").distinct()
    return s.select("session_id", F.round(text.stable_fraction(42, F.col("session_id")), 12).alias("fraction"))


@query("""with x as (select probe_index, min(metadata_json) m, min(reference) r, min(probe_id) p from probes group by 1)
select probe_index, coalesce(nullif(trim(json_extract_string(m, '$.id')), ''), nullif(trim(p), ''), substr(sha256(coalesce(r, '')), 1, 24)) as record_id from x""")
def scl12_record_id(spark, sf):
    x = table(spark, sf, "probes").groupBy("probe_index").agg(F.min("metadata_json").alias("m"), F.min("reference").alias("r"), F.min("probe_id").alias("p"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    key = F.coalesce(blank(F.get_json_object("m", "$.id")), blank(F.col("p")), F.substring(F.sha2(F.coalesce("r", F.lit("")), 256), 1, 24))
    return x.select("probe_index", key.alias("record_id"))


@query("select item_id, list_aggregate([trim(x) for x in incorrect_answers if trim(x) <> ''], 'string_agg', '|') as answers, len(incorrect_answers)::bigint as n from eval_items")
def scl13_string_list(spark, sf):
    e = table(spark, sf, "eval_items")
    return e.select("item_id", F.array_join(text.string_list(F.col("incorrect_answers")), "|").alias("answers"), F.size("incorrect_answers").cast("bigint").alias("n"))


@query("""select vec_id, row_number() over (partition by label order by sha256('validation_order:42:' || vec_id), vec_id)::bigint as rank, label from embeddings""")
def scl14_validation_order(spark, sf):
    key = F.sha2(F.concat(F.lit("validation_order:42:"), F.col("vec_id").cast("string")), 256)
    rows = table(spark, sf, "embeddings").select("vec_id", "label", key.alias("k"))
    return indexing.group_index(rows, ["label"], ["k", "vec_id"], "rank").select("vec_id", (F.col("rank") + 1).alias("rank"), "label")


@query("""with o as (select item_id, unnest(list_concat([correct_answer], incorrect_answers)) as opt, generate_subscripts(list_concat([correct_answer], incorrect_answers), 1) - 1 as pos from eval_items),
r as (select item_id, opt, pos, row_number() over (partition by item_id order by sha256(concat_ws(chr(0), '42', item_id, pos::varchar)), pos) - 1 as rank from o)
select item_id, string_agg(opt, '|' order by rank) as options, max(case when pos = 0 then rank end)::bigint as gold from r group by 1""")
def scl15_shuffled_options(spark, sf):
    from sessionloom.operators import benchmarks

    e = table(spark, sf, "eval_items")
    options = F.concat(F.array("correct_answer"), F.col("incorrect_answers"))
    o = benchmarks.shuffled_options(F.col("item_id"), options, 42)
    return e.select("item_id", F.array_join(o["options"], "|").alias("options"), o["gold"].cast("bigint").alias("gold"))


@query(f"with {EXACT} select doc_id, md5(trim(regexp_replace(t, '[\\s\\pZ\\x1c-\\x1f\\x85]+', ' ', 'g'), ' ')) as digest from nx")
def scl25_quality_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.quality_normalize(F.col("text"))).alias("digest"))


@query("select doc_id, md5(trim(regexp_replace(regexp_replace(coalesce(text, ''), '\\[/?INST\\]|</?s>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) as digest from documents")
def scl29_clean_prompt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.clean_prompt(F.coalesce("text", F.lit("")))).alias("digest"))


@query("""select item_id, list_aggregate([chr((64 + i)::int) || '. ' || o[i] for i in range(1, len(o) + 1)], 'string_agg', chr(10)) as lines
from (select item_id, list_concat([correct_answer], incorrect_answers) o from eval_items)""")
def scl30_option_lines(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", text.option_lines(F.concat(F.array("correct_answer"), F.col("incorrect_answers"))).alias("lines"))


@query("select item_id, substr(sha256(concat_ws(chr(0), benchmark, passage)), 1, 16) as key16, substr(sha256(concat_ws(chr(0), item_id)), 1, 24) as key24 from eval_items")
def scl31_asset_keys(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", text.asset_key(16, F.col("benchmark"), F.col("passage")).alias("key16"), text.asset_key(24, F.col("item_id")).alias("key24"))


@query("""select source_record_id, case when trim(source_record_id) = '' then 'blank' when source_record_id like '/%' then 'absolute' when regexp_matches(source_record_id, '(^|/)\\.\\.(/|$)') then 'parent'
when not starts_with(source_record_id, 'rej-00-0000') then 'prefix' end as reason from (select distinct source_record_id from rejections)""")
def scl32_history_path(spark, sf):
    r = table(spark, sf, "rejections").select("source_record_id").distinct()
    return r.withColumn("reason", text.safe_history_path(F.col("source_record_id"), "rej-00-0000"))


@query("select role, case lower(role) when 'environment' then 'environment' when 'tool' then 'tool' when 'user' then 'user' when 'assistant' then 'assistant' when 'system' then 'system' end as canonical, count(*) as n from session_events group by 1, 2")
def scl34_roles(spark, sf):
    return table(spark, sf, "session_events").groupBy("role", text.canonical_role(F.col("role")).alias("canonical")).agg(F.count("*").alias("n"))


@query("""with k as (select *, regexp_replace(lower(regexp_replace(source, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), '[\\s\\pZ_-]+', '_', 'g') as key from sessions)
select coalesce(c.source, k.key) as source, coalesce(c.domain, k.domain) as domain, count(*) as n from k left join source_catalog c on c.source = k.key group by 1, 2""")
def names_proper_sources(spark, sf):
    return names.proper_names(table(spark, sf, "sessions").select("source", "domain"), table(spark, sf, "source_catalog")).groupBy("source", "domain").agg(F.count("*").alias("n"))


# ---- canonical sessions ---------------------------------------------------------------------------

EVENT_LIST = "x as (select session_id, source, domain, session_index, unnest(from_json(events_json, '[\"json\"]')) as ev, generate_subscripts(from_json(events_json, '[\"json\"]'), 1) as pos from s where events_json is not null)"


def _sessions(spark, sf):
    return canonical.sessions_with_events(table(spark, sf, "sessions"))


@query(f"""with {FIRST_SESSIONS}, {EVENT_LIST},
l as (select session_id, source, domain, pos, ev->>'$.id' id, ev->>'$.role' as role, coalesce(ev->>'$.type', 'message') t, {STRIP.format("ev->>'$.content'")} c, {STRIP.format("ev->>'$.name'")} n, {STRIP.format("ev->>'$.status'")} st, ev->>'$.arguments' a from x),
r as (select session_id, source, domain, pos, '[' || case when t = 'message' then upper(role[1]) || role[2:] || ' Message' when t = 'tool_call' then 'Tool Call' when t = 'tool_result' then 'Tool Result' when t = 'artifact' then 'Artifact Observation'
 when t = 'observation' then 'Observation' when t = 'state_change' then 'State Change' when t = 'decision' then 'Decision' else 'Action Summary' end || ' | id=' || id
 || case when t = 'tool_call' or (t = 'tool_result' and n <> '') then ' | name=' || n else '' end || case when t = 'tool_result' and st <> '' then ' | status=' || st else '' end || ']' || chr(10)
 || case when t = 'tool_call' then coalesce(a, '{{}}') || case when c <> '' then chr(10) || c else '' end else c end as line from l)
select session_id, md5({STRIP.format("'[Session | id=' || session_id || ' | source=' || " + STRIP.format("source") + " || ' | domain=' || " + STRIP.format("domain") + " || ']' || chr(10) || string_agg(line, chr(10) order by pos)")}) as rendered from r group by session_id, source, domain""")
def scl9_render(spark, sf):
    s = _sessions(spark, sf).where("events_json is not null")
    return s.select("session_id", F.md5(canonical.render(F.col("session_id"), F.col("source"), F.col("domain"), F.col("events"))).alias("rendered"))


DEDUP_TEXT = f"""with {FIRST_SESSIONS}, {EVENT_LIST},
p as (select session_id, session_index, source, domain, pos, unnest([{STRIP.format("ev->>'$.role'")}, coalesce(ev->>'$.type', 'message'), {STRIP.format("ev->>'$.name'")}, {STRIP.format("ev->>'$.content'")}, {STRIP.format("ev->>'$.status'")}, coalesce(ev->>'$.arguments', '')]) as part, unnest([1, 2, 3, 4, 5, 6]) as k from x),
d as (select session_id, min(session_index) session_index, min(source) source, min(domain) as domain, string_agg(part, chr(10) order by pos, k) filter (part <> '') as t from p group by session_id),
{exact.tables()}, {exact.normalized("nx", "d", "session_id", "t")},
h as (select d.session_id, session_index, source, domain, sha256({exact.joined("nx.t")}) as h, len({exact.words("nx.t")})::bigint as w from d join nx using (session_id))"""


def _hashed(spark, sf):
    s = _sessions(spark, sf).where("events_json is not null")
    t = text.normalize_exact(canonical.dedup_text(F.col("events")))
    rows = s.select("session_id", "session_index", "source", "domain", t.alias("t"))
    return rows.select("session_id", "session_index", "source", "domain", F.sha2("t", 256).alias("h"), text.normalized_words(F.col("t")).alias("w"))


@query(DEDUP_TEXT + " select session_id, h, w from h")
def scl10_dedup_text(spark, sf):
    return _hashed(spark, sf).select("session_id", "h", "w")


@query(f"""with {FIRST_SESSIONS}, {EVENT_LIST},
l as (select session_id, {STRIP.format("ev->>'$.id'")} id, {STRIP.format("ev->>'$.role'")} as role, coalesce(ev->>'$.type', 'message') t, {STRIP.format("ev->>'$.content'")} c, {STRIP.format("ev->>'$.name'")} n from x),
g as (select session_id, bool_or(id = '') b1, count(distinct id) < count(*) b2, bool_or(role not in ('system', 'user', 'assistant', 'tool', 'environment')) b3,
 bool_or(t not in ('message', 'tool_call', 'tool_result', 'observation', 'artifact', 'state_change', 'decision', 'action_summary')) b4, bool_or(t = 'tool_call' and n = '') b5, bool_or(t <> 'tool_call' and c = '') b6 from l group by 1)
select s.session_id, case when g.session_id is null then 'events' when b1 then 'event_id' when b2 then 'duplicate_event_id' when b3 then 'role' when b4 then 'type' when b5 then 'tool_call_name' when b6 then 'content' end as error from s left join g using (session_id)""")
def flt8_validate_session(spark, sf):
    return _sessions(spark, sf).select("session_id", canonical.first_error(F.col("session_id"), F.col("events")).alias("error"))


@query("select probe_index, case when len(evidence_event_ids) > 0 then 1 else 0 end = case when answerable then 1 else 0 end as consistent, coalesce(regexp_replace(reference, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g'), '') = '' and answerable as blank from (select probe_index, min(evidence_event_ids) evidence_event_ids, min(answerable) answerable, min(reference) reference from probes group by 1)")
def flt8_validate_probes(spark, sf):
    p = table(spark, sf, "probes").groupBy("probe_index").agg(F.min("evidence_event_ids").alias("e"), F.min("answerable").alias("a"), F.min("reference").alias("r"))
    return p.select("probe_index", ((F.size("e") > 0) == F.col("a")).alias("consistent"), ((text.strip(F.col("r")) == "") & F.col("a")).alias("blank"))


# ---- deduplication --------------------------------------------------------------------------------


@query(DEDUP_TEXT + " select session_id, row_number() over (partition by h order by session_index) > 1 as duplicate from h")
def win7_first_wins(spark, sf):
    return dedup.exact_duplicates(_hashed(spark, sf), "h", "session_index").select("session_id", (~F.col("is_first")).alias("duplicate"))


SIMHASH_SQL = f"with {EXACT}, " + """w as (select doc_id, [x for x in string_split(t, ' ') if x <> ''] as ws from (select doc_id, """ + exact.joined("t") + """ t from nx)),
g as (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, chr(0))] else [ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] for i in range(1, len(ws) - 1)] end) as gram from w),
b as (select doc_id, ('0x' || substr(md5(gram), 1, 16))::ubigint as h from g),
c as (select doc_id, count(*) n, """ + ", ".join(f"sum((h >> {i}) & 1) b{i}" for i in range(64)) + """ from b group by 1)"""


@query(SIMHASH_SQL + " select doc_id, " + " || ".join(f"case when 2 * coalesce(b{i}, 0) >= coalesce(n, 1) then '1' else '0' end" for i in reversed(range(64))) + " as bits from (select doc_id from documents) left join c using (doc_id)")
def scl3_simhash_md5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.normalize_exact(F.col("text")).alias("t"))
    h = d.select("doc_id", text.simhash64(3, "md5")(F.col("t")).alias("h"))
    return h.select("doc_id", F.lpad(F.bin("h"), 64, "0").alias("bits"))


def _simhashed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.normalize_exact(F.col("text")).alias("t"))
    return d.select("doc_id", F.sha2("t", 256).alias("h"), text.simhash64()(F.col("t")).alias("sim"), F.size(F.filter(F.split("t", " "), lambda x: x != "")).alias("w"))


BITS = " + ".join(f"case when 2 * b{i} >= n then {1 << i}::ubigint else 0::ubigint end" for i in range(64))


@query(SIMHASH_SQL + f""", h as (select doc_id, {BITS} as h from c), w2 as (select doc_id, len(ws) as w from w), f as (select h, min(doc_id) as i from h join w2 using (doc_id) where w >= 20 group by 1)
select least(a.i, b.i) as a, greatest(a.i, b.i) as b, bit_count(xor(a.h, b.h))::int as distance from f a join f b on a.h < b.h where bit_count(xor(a.h, b.h)) <= 5""")
def jn5_band_candidates(spark, sf):
    """Six bands find all pairs of up to five differing bits: one band at least has none of them."""
    d = table(spark, sf, "documents").select("doc_id", text.normalize_exact(F.col("text")).alias("t"))
    rows = d.select("doc_id", text.simhash64(3, "md5")(F.col("t")).alias("sim"), text.normalized_words(F.col("t")).alias("w")).where("w >= 20")
    return dedup.candidate_pairs(rows, "doc_id", "sim", 5, 6, 10)


@query()
def st5_greedy_dedup(spark, sf):
    return dedup.classify(_simhashed(spark, sf), "doc_id", "h", "sim", "w").select("doc_id", "verdict")


@query(f"""with {EXACT}, pats as (select unnest(['as far as i know', 'the note says that', 'laut notiz']) p, unnest([1, 2, 3]) k)
select doc_id, (select arg_min(p, k) from pats where contains({exact.joined('t')}, p)) as excluded from nx""")
def flt5_excluded_text(spark, sf):
    d = table(spark, sf, "documents")
    patterns = ["as far as i know", "the note says that", "laut notiz"]
    return d.select("doc_id", dedup.excluded_by(text.normalize_exact(F.col("text")), patterns).alias("excluded"))


# ---- splits and positions -------------------------------------------------------------------------


@query(DEDUP_TEXT + f""" select split, domain, count(*) as sessions, sum(w)::bigint as words from (select domain, w, case when {FRACTION.format(42, 'session_id')} < 0.01 then 'validation' else 'train' end as split,
row_number() over (partition by h order by session_index) rn from h) where rn = 1 group by 1, 2""")
def flagship_split_counts(spark, sf):
    """Sessions, exact duplicates removed, by split and domain: adapt, hash, first wins, split, count."""
    kept = canonical.first_rows(_hashed(spark, sf), ["h"], ["session_index"])
    return splits.session_split(kept).groupBy("split", "domain").agg(F.count("*").alias("sessions"), F.sum("w").alias("words"))


@query(f"select split, count(*) as n from (select distinct session_id, case when {FRACTION.format(7, 'session_id')} < 0.1 then 'validation' else 'train' end as split from sessions) group by 1")
def scl6_split(spark, sf):
    return splits.session_split(table(spark, sf, "sessions").select("session_id").distinct(), 7, 0.1).groupBy("split").agg(F.count("*").alias("n"))


PROBES = "p as (select probe_index, min(session_id) session_id, min(probe_id) probe_id, min(prompt) prompt, min(reference) reference, min(probe_type) probe_type, min(answerable) answerable from probes group by 1)"


def _probes(spark, sf):
    cols = ["session_id", "probe_id", "prompt", "reference", "probe_type", "answerable"]
    return table(spark, sf, "probes").groupBy("probe_index").agg(*[F.min(c).alias(c) for c in cols])


HELD = f"""with {PROBES}, r as (select *, row_number() over (partition by session_id order by {HEX.format(42, 'session_id, probe_id')}, probe_index) as rank, count(*) over (partition by session_id) n,
case when {FRACTION.format(42, 'session_id')} < 0.01 then 'validation' else 'train' end as ss from p),
q as (select *, case when ss = 'validation' then 'validation' when rank <= least(2, greatest(n - 1, 0)) then 'query_validation' else 'train' end as split from r)"""


@query(HELD + " select probe_index, rank <= least(2, greatest(n - 1, 0)) as held_out from q")
def win4_held_out(spark, sf):
    return splits.held_out_probes(_probes(spark, sf)).select("probe_index", "held_out")


@query(HELD + " select split, session_id, list_aggregate(list(probe_index order by probe_index), 'string_agg', ',') as indices from q group by 1, 2")
def snk_split_index(spark, sf):
    return splits.split_index(splits.probe_splits(_probes(spark, sf))).select("split", "session_id", F.array_join(F.col("probe_indices").cast("array<string>"), ",").alias("indices"))


@query("select session_id, (row_number() over (order by session_id) - 1)::bigint as idx from (select distinct session_id from sessions)")
def win1_dense_index(spark, sf):
    return indexing.dense_index(table(spark, sf, "sessions").select("session_id").distinct(), ["session_id"], "idx")


@query("""with t as (select session_index, min(probe_count) as n from sessions group by 1)
select session_index, coalesce(sum(n) over (order by session_index rows between unbounded preceding and 1 preceding), 0)::bigint as probe_start from t""")
def win2_probe_start(spark, sf):
    s = table(spark, sf, "sessions").groupBy("session_index").agg(F.min("probe_count").alias("n"))
    return indexing.running_sum(s, ["session_index"], F.col("n"), "probe_start").select("session_index", "probe_start")


@query(f"""with {DISTINCT_EVENTS} select a.session_id, a.event_index, a.role, a.event_type from e a join e b on a.session_id = b.session_id and a.event_index = b.event_index + 1
where (a.role = 'assistant' and b.role = 'user' and a.event_type = 'message' and b.event_type = 'message') or (a.event_type = 'tool_result' and b.event_type = 'tool_call')""")
def win3_adjacent_pairs(spark, sf):
    rows = store.adjacent(events(spark, sf).select("session_id", "event_index", "role", "event_type"), "session_id", "event_index", ["role", "event_type"])
    turn = (F.col("role") == "assistant") & (F.col("prev_role") == "user") & (F.col("event_type") == "message") & (F.col("prev_event_type") == "message")
    tool = (F.col("event_type") == "tool_result") & (F.col("prev_event_type") == "tool_call")
    return rows.where(turn | tool).select("session_id", "event_index", "role", "event_type")


@query("select session_id, session_index, session_index % 4 as shard from (select distinct session_id, session_index from sessions) where session_index % 4 = 1")
def win10_modulo_shard(spark, sf):
    s = table(spark, sf, "sessions").select("session_id", "session_index").distinct()
    return s.withColumn("shard", F.pmod("session_index", F.lit(4))).where("shard = 1")


# ---- joins and audits -----------------------------------------------------------------------------


@query("""with i as (select session_index, session_id, unnest(probe_indices) as probe_index, generate_subscripts(probe_indices, 1) as pos from split_index),
p as (select probe_index, min(session_id) owner, min(prompt) prompt, min(reference) reference from probes group by 1),
g as (select i.session_index, i.session_id, string_agg(prompt, '|' order by pos) prompts, string_agg(coalesce(reference, '~'), '|' order by pos) refs from i left join p using (probe_index) group by 1, 2),
c as (select session_index, min(context) as context from sessions group by 1)
select s.session_index, s.session_id, md5(coalesce(c.context, '')) as context, coalesce(prompts, '') as prompts, coalesce(refs, '') as refs from split_index s left join g using (session_index, session_id) left join c using (session_index)""")
def jn1_read_samples(spark, sf):
    r = store.read_samples(table(spark, sf, "split_index"), table(spark, sf, "sessions"), table(spark, sf, "probes"))
    return r.select("session_index", "session_id", F.md5(F.coalesce("context", F.lit(""))).alias("context"), F.array_join("prompts", "|").alias("prompts"), F.array_join("references", "|", "~").alias("refs"))


@query("""with s as (select session_id, min(session_index) i, min(probe_start) a, min(probe_count) n from sessions group by 1), p as (select distinct session_id, probe_index from probes)
select p.session_id, p.probe_index from p left join s using (session_id) where not coalesce(probe_index >= a and probe_index < a + n, false)""")
def jn2_range_audit(spark, sf):
    return store.range_audit(table(spark, sf, "sessions"), table(spark, sf, "probes"))


@query("""select i.session_id, s.session_id is null as missing, coalesce(i.session_id <> s.session_id, true) as differs from split_index i left join (select session_index, min(session_id) session_id from sessions group by 1) s using (session_index)""")
def jn3_index_session(spark, sf):
    s = table(spark, sf, "sessions").groupBy("session_index").agg(F.min("session_id").alias("sid"))
    j = table(spark, sf, "split_index").join(s, "session_index", "left")
    return j.select("session_id", F.col("sid").isNull().alias("missing"), F.coalesce(F.col("session_id") != F.col("sid"), F.lit(True)).alias("differs"))


@query("""with l as (select session_id, count(*) n, min(md5(coalesce(events_json, ''))) d from sessions group by 1), r as (select session_id, count(*) n, min(md5(array_to_string(probe_indices, ','))) d from split_index group by 1)
select coalesce(l.session_id, r.session_id) as session_id, case when l.n > 1 then 'duplicate_left' when r.n > 1 then 'duplicate_right' when r.n is null then 'missing' when l.n is null then 'unexpected' end as status from l full join r using (session_id) where l.n > 1 or r.n > 1 or r.n is null or l.n is null""")
def jn4_coverage(spark, sf):
    return store.coverage(table(spark, sf, "sessions").select("session_id"), table(spark, sf, "split_index").select("session_id"), ["session_id"])


@query("""with n as (select max(session_index) + 1 as n from split_index), e as (select range as i from n, range(0, n.n)), t as (select session_index, count(*) c from sessions where session_index < (select n from n) group by 1)
select coalesce(e.i, t.session_index) as sample_idx, coalesce(t.c, 0)::bigint as rows from e full join t on t.session_index = e.i where coalesce(t.c, 0) <> 1""")
def jn6_teacher_coverage(spark, sf):
    """Samples 0..n-1 that have no row, or more than one, in a table that must hold each once."""
    n = table(spark, sf, "split_index").agg(F.max("session_index")).first()[0] + 1
    have = table(spark, sf, "sessions").where(F.col("session_index") < n).groupBy(F.col("session_index").alias("sample_idx")).agg(F.count("*").alias("rows"))
    every = spark.range(n).withColumnRenamed("id", "sample_idx").join(have, "sample_idx", "full_outer")
    return every.withColumn("rows", F.coalesce("rows", F.lit(0))).where("rows != 1").select("sample_idx", "rows")


@query("select benchmark, count(distinct persona_id) as personas, count(*) as n, count(distinct persona_id) = 1 as single from eval_items group by 1")
def jn8_group_key(spark, sf):
    return table(spark, sf, "eval_items").groupBy("benchmark").agg(F.count_distinct("persona_id").alias("personas"), F.count("*").alias("n"), (F.count_distinct("persona_id") == 1).alias("single"))


@query(f"""with {DISTINCT_EVENTS}, ids as (select session_id, list(event_id) ids from e group by 1), p as (select probe_index, min(session_id) session_id, min(evidence_event_ids) ev from probes group by 1)
select probe_index, len([x for x in list_distinct(ev) if not list_contains(coalesce(ids, []), x)])::bigint as foreign_ids from p left join ids using (session_id)""")
def jn12_evidence_subset(spark, sf):
    """Evidence that is not among the session's events, by a join on single ids instead of gathered lists."""
    p = table(spark, sf, "probes").groupBy("probe_index").agg(F.min("session_id").alias("session_id"), F.min("evidence_event_ids").alias("ev"))
    cited = p.select("probe_index", "session_id", F.explode_outer(F.array_distinct("ev")).alias("event_id"))
    own = table(spark, sf, "session_events").select("session_id", "event_id").distinct().withColumn("known", F.lit(True))
    j = cited.join(own, ["session_id", "event_id"], "left")
    return j.groupBy("probe_index").agg(F.count_if(F.col("event_id").isNotNull() & F.col("known").isNull()).alias("foreign_ids"))


@query(HELD + """, i as (select split, session_id, list(probe_index) as ps from q group by 1, 2) select a.session_id, len(list_intersect(a.ps, b.ps))::bigint as shared_probes from i a join i b using (session_id) where a.split = 'train' and b.split = 'query_validation'""")
def flt9_split_overlap(spark, sf):
    i = splits.split_index(splits.probe_splits(_probes(spark, sf)))
    return store.split_overlaps(i.where("split = 'train'"), i.where("split = 'query_validation'"))


@query("""with t as (select session_index, min(session_id) session_id, min(probe_start) a, min(probe_count) n from sessions group by 1) select b.session_index, b.session_id from t a join t b on b.session_index = a.session_index + 1 where a.a + a.n <> b.a""")
def win9_order_audit(spark, sf):
    return store.order_audit(table(spark, sf, "sessions"))


@query("select (row_number() over (order by k, id) - 1)::bigint as global_index, store, id from (select 'probes' as store, 0 as k, probe_index as id from (select distinct probe_index from probes) union all select 'vectors', 1, vec_id from embeddings)")
def src12_composite_store(spark, sf):
    a = table(spark, sf, "probes").select(F.col("probe_index").alias("id")).distinct()
    b = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return store.composite({"probes": a, "vectors": b}, "id").select("global_index", "store", "id")
