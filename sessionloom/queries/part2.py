"""Queries of array functions, objectives, quality, batching, aggregates and the memory fold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.functions import arrays, text
from sessionloom.operators import benchmarks, indexing, memory, objectives, quality, splits
from sessionloom.plans.runtime import table
from sessionloom.queries import exact
from sessionloom.queries.part1 import DISTINCT_EVENTS, NORM, PROBES, WORDS, _probes, events

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LOGITS = """v as (select vec_id, label, embedding::double[] as x, [y * 4 for y in list_reverse(embedding::double[])] as y from embeddings),
n as (select vec_id, label, [a - (list_max(x) + ln(list_sum([exp(b - list_max(x)) for b in x]))) for a in x] as s, [a - (list_max(y) + ln(list_sum([exp(b - list_max(y)) for b in y]))) for a in y] as t from v),
k as (select *, list_sort([{'m': -t[i], 'i': i} for i in range(1, 65)])[:8] as tk, list_sort([{'m': -s[i], 'i': i} for i in range(1, 65)])[:8] as sk from n)"""


def _logits(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    y = F.transform(F.reverse("x"), lambda v: v * 4)
    return e.select("vec_id", "label", objectives.log_softmax(F.col("x")).alias("s"), objectives.log_softmax(y).alias("t"))


@query(f"with {LOGITS} select vec_id, round(-list_sum([exp(-e.m) * s[e.i] for e in tk]), 6) as loss from k")
def obj1_top_k_cross_entropy(spark, sf):
    return _logits(spark, sf).select("vec_id", F.round(objectives.cross_entropy_top_k(F.col("t"), F.col("s"), 8), 6).alias("loss"))


TAIL = "(list_sum([exp({p}[e.i]) * ({p}[e.i] - {q}[e.i]) for e in {k}]) + greatest(1 - list_sum([exp({p}[e.i]) for e in {k}]), 1e-12) * (ln(greatest(1 - list_sum([exp({p}[e.i]) for e in {k}]), 1e-12)) - ln(greatest(1 - list_sum([exp({q}[e.i]) for e in {k}]), 1e-12))))"


@query(f"with {LOGITS} select vec_id, round({TAIL.format(p='t', q='s', k='tk')}, 6) as loss from k")
def obj2_forward_kl_tail(spark, sf):
    return _logits(spark, sf).select("vec_id", F.round(objectives.kl_top_k_tail(F.col("t"), F.col("s"), 8), 6).alias("loss"))


@query(f"""with {LOGITS}, c2 as (select vec_id, s, [e.i for e in tk] as ids, [ln(exp(-e.m) / list_sum([exp(-z.m) for z in tk]) * (0.9 + (vec_id % 5) * 0.025)) for e in tk] as t from k),
m2 as (select *, greatest(list_sum([exp(x) for x in t]), 1.0) as mass from c2), n2 as (select vec_id, s, ids, [exp(x) / mass for x in t] as p from m2),
r2 as (select *, greatest(1 - list_sum(p), 0) as tp, greatest(1 - list_sum([exp(s[i]) for i in ids]), 0) as tq from n2)
select vec_id, round(list_sum([p[j] * (ln(p[j]) - s[ids[j]]) for j in range(1, len(p) + 1)]) + case when tp > 0 then tp * (ln(tp) - ln(tq)) else 0 end, 5) as loss from r2""")
def obj2_stored_forward_kl(spark, sf):
    """Stored rows whose masses lie between 0.9 and 1."""
    d = _logits(spark, sf)
    picks = objectives.top_k(F.col("t"), 8)
    rows = d.select("vec_id", "s", F.transform(picks, lambda e: e["i"]).alias("ids"), F.transform(picks, lambda e: e["lp"]).alias("lps"))
    mass = objectives.total(F.transform("lps", F.exp))
    scaled = F.transform("lps", lambda x: F.log(F.exp(x) / F.col("_m") * (0.9 + (F.col("vec_id") % 5) * 0.025)))
    rows = rows.withColumn("_m", mass).withColumn("lps", scaled)
    return rows.select("vec_id", F.round(objectives.stored_forward_kl(F.col("s"), F.col("ids"), F.col("lps")), 5).alias("loss"))


@query(f"with {LOGITS} select vec_id, round({TAIL.format(p='s', q='t', k='sk')}, 6) as loss from k")
def obj3_reverse_kl_tail(spark, sf):
    return _logits(spark, sf).select("vec_id", F.round(objectives.kl_top_k_tail(F.col("s"), F.col("t"), 8), 6).alias("loss"))


@query(f"with {LOGITS}, j as (select *, [{{'i': z}} for z in list_distinct([vec_id % 64 + 1, (vec_id * 7) % 64 + 1, vec_id % 64 + 1, (vec_id * 13 + 5) % 64 + 1])] as dk from k) select vec_id, round({TAIL.format(p='s', q='t', k='dk')}, 6) as loss from j")
def obj4_support_reverse_kl(spark, sf):
    v = F.col("vec_id")
    ids = F.array((v % 64).cast("int"), ((v * 7) % 64).cast("int"), (v % 64).cast("int"), ((v * 13 + 5) % 64).cast("int"))
    return _logits(spark, sf).select("vec_id", F.round(objectives.support_reverse_kl(F.col("s"), F.col("t"), ids), 6).alias("loss"))


@query(f"with {LOGITS}, r as (select vec_id, greatest(least(t[1] - s[1], 20), -20) as r from k) select vec_id, round(greatest(least(exp(r) - r - 1, 10), -10), 6) as loss from r")
def obj5_sampled_k3(spark, sf):
    return _logits(spark, sf).select("vec_id", F.round(objectives.k3(F.col("s")[0], F.col("t")[0]), 6).alias("loss"))


@query(f"with {LOGITS} select vec_id, round(-s[label % 64 + 1], 6) as loss, (list_position(s, list_max(s)) - 1)::bigint as choice from k")
def obj6_choice_cross_entropy(spark, sf):
    g = (F.col("label") % 64).cast("int")
    return _logits(spark, sf).select("vec_id", F.round(objectives.choice_cross_entropy(F.col("s"), g), 6).alias("loss"), objectives.argmax(F.col("s")).cast("bigint").alias("choice"))


@query("select session_id, event_index - 1 as at, event_index as label_pos from (with " + DISTINCT_EVENTS + " select * from e) where role = 'assistant' and event_index > 0")
def obj7_label_positions(spark, sf):
    return events(spark, sf).where("role = 'assistant' and event_index > 0").select("session_id", (F.col("event_index") - 1).alias("at"), F.col("event_index").alias("label_pos"))


@query("select vec_id, round(list_sum([abs(x) for x in embedding::double[]]), 6) as l1, round(sqrt(list_sum([x * x for x in embedding::double[]])), 6) as l2 from embeddings")
def obj8_norms(spark, sf):
    l1, l2 = objectives.norms(F.col("embedding").cast("array<double>"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(l1, 6).alias("l1"), F.round(l2, 6).alias("l2"))


@query(f"with {LOGITS} select label, round(avg(t[1] - s[1]), 6) as lift, count(*) as n from k group by 1")
def obj9_context_lift(spark, sf):
    return _logits(spark, sf).groupBy("label").agg(F.round(F.avg(F.col("t")[0] - F.col("s")[0]), 6).alias("lift"), F.count("*").alias("n"))


@query("select vec_id, round(list_sum(m), 6) as total, len(m)::bigint as size from (select vec_id, flatten([list_concat((embedding::double[])[1 + 16 * c:16 * c + 1 + (vec_id + c) % 16], [0.0 for z in range(0, 15 - (vec_id + c) % 16)]) for c in range(0, 4)]) as m from embeddings)")
def obj10_merge_chunks(spark, sf):
    e = F.col("embedding").cast("array<double>")
    chunks = F.array(*[F.slice(e, 1 + 16 * c, 16) for c in range(4)])
    ranks = F.array(*[((F.col("vec_id") + c) % 16 + 1).cast("int") for c in range(4)])
    m = objectives.merge_chunks(chunks, ranks, 16)
    return table(spark, sf, "embeddings").select("vec_id", F.round(objectives.total(m), 6).alias("total"), F.size(m).cast("bigint").alias("size"))


@query("""with c as (select vec_id, vec_id % 3 + 1 as n, embedding::double[] as x from embeddings)
select vec_id, round(list_sum(x[1:16 * n]) + 0.5 * list_sum(x[49:64]), 6) as total, 64::bigint as size, round(case when n < 3 then 0.0 else 0.5 * x[64] end, 6) as last from c""")
def obj10_combine_chunks(spark, sf):
    """One to three chunks of four rows of four, then a bias at half weight, then zeros."""
    e = F.col("embedding").cast("array<double>")
    rows = lambda at: F.array(*[F.slice(e, at + 4 * r, 4) for r in range(4)])
    chunks = F.slice(F.array(rows(1), rows(17), rows(33)), F.lit(1), (F.col("vec_id") % 3 + 1).cast("int"))
    m = F.flatten(objectives.combine_chunks(chunks, 3, 4, rows(49), 0.5))
    return table(spark, sf, "embeddings").select("vec_id", F.round(objectives.total(m), 6).alias("total"), F.size(m).cast("bigint").alias("size"), F.round(F.element_at(m, -1), 6).alias("last"))


@query("select vec_id, round(case when vec_id < 50 then vec_id / 50.0 else 0.5 * (1 + cos(pi() * least((vec_id - 50) / 400.0, 1.0))) end, 6) as factor from embeddings")
def obj11_warmup_cosine(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(objectives.warmup_cosine(F.col("vec_id"), 50, 450), 6).alias("factor"))


# ---- arrays and batches ---------------------------------------------------------------------------

IDS = "d as (select session_index, session_id, probe_indices as ids from split_index)"


def _ids(spark, sf):
    return table(spark, sf, "split_index").select("session_index", "session_id", F.col("probe_indices").alias("ids"))


@query("select session_index, array_to_string([(session_index + 3 * least(n, 4) + j) % n for j in range(0, least(n, 4))], ',') as rows from (select session_index, len(probe_indices) as n from split_index)")
def scl18_rotating_rows(spark, sf):
    r = arrays.rotating_rows(F.size("ids").cast("bigint"), F.col("session_index"), F.lit(3).cast("bigint"), 4)
    return _ids(spark, sf).select("session_index", F.array_join(r.cast("array<string>"), ",").alias("rows"))


@query("select session_index, list_sum([case when i <= e then 1 else 0 end for i in range(1, len(ids) + 1)])::bigint as ones, len(ids)::bigint as n from (select session_index, ids, coalesce(least(nullif(list_position(m, 3), 0), nullif(list_position(m, 5), 0)), len(ids)) as e from (select session_index, probe_indices as ids, [x % 7 for x in probe_indices] m from split_index)) where len(ids) > 0")
def scl20_response_mask(spark, sf):
    d = _ids(spark, sf).where("size(ids) > 0").withColumn("m", F.transform("ids", lambda x: x % 7))
    mask = arrays.response_mask(F.col("m"), [3, 5])
    return d.select("session_index", F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("bigint").alias("ones"), F.size("ids").cast("bigint").alias("n"))


@query("select session_index, array_to_string([greatest(list_sum(m[:i]) - 1, 0)::bigint for i in range(1, len(m) + 1)], ',') as pos from (select session_index, [case when x % 3 = 0 then 0 else 1 end for x in probe_indices] m from split_index where len(probe_indices) > 0)")
def scl21_position_ids(spark, sf):
    m = F.transform("ids", lambda x: (x % 3 != 0).cast("int"))
    return _ids(spark, sf).where("size(ids) > 0").select("session_index", F.array_join(arrays.position_ids(m).cast("array<string>"), ",").alias("pos"))


@query("select session_index, array_to_string(case when n <= 3 then ids else ids[greatest(least(2, n), 3) - 2:greatest(least(2, n), 3)] end, ',') as kept from (select session_index, probe_indices as ids, len(probe_indices) n from split_index)")
def scl22_truncate_keep_span(spark, sf):
    kept = arrays.truncate_keep_span(F.col("ids"), F.lit(0), F.lit(2), 3)
    return _ids(spark, sf).select("session_index", F.array_join(kept.cast("array<string>"), ",").alias("kept"))


@query("select session_index, case when n >= 2 then 1 else -1 end as at from (select session_index, len(probe_indices) n from split_index)")
def scl23_align(spark, sf):
    needle = F.slice(F.col("ids"), 2, 2)
    return _ids(spark, sf).select("session_index", arrays.find_sub(F.col("ids"), needle).alias("at"))


@query("select session_index, array_to_string([x for x in m[:e - 1] if x not in (1, 2)], ',') as kept from (select session_index, m, coalesce(nullif(list_position(m, 5), 0), len(m) + 1) as e from (select session_index, [x % 7 for x in probe_indices] m from split_index))")
def scl26_trim_row(spark, sf):
    m = F.transform("ids", lambda x: x % 7)
    d = _ids(spark, sf).withColumn("m", m)
    return d.select("session_index", F.array_join(arrays.trim_row(F.col("m"), [5], [1, 2]).cast("array<string>"), ",").alias("kept"))


BATCH = "b as (select session_index, session_index // 8 as batch, ids, max(len(ids)) over (partition by session_index // 8) as size from (select session_index, probe_indices ids from split_index))"


def _batched(spark, sf):
    d = _ids(spark, sf).withColumn("batch", F.expr("session_index div 8"))
    return d.withColumn("size", F.max(F.size("ids")).over(Window.partitionBy("batch")))


@query(f"with {BATCH} select session_index, batch, array_to_string(list_concat(ids, [0 for z in range(0, size - len(ids))]), ',') as input_ids, array_to_string(list_concat([1 for z in ids], [0 for z in range(0, size - len(ids))]), ',') as mask, array_to_string(list_concat(ids, [-100 for z in range(0, size - len(ids))]), ',') as labels from b")
def bat1_right_pad(spark, sf):
    d, size = _batched(spark, sf), F.col("size")
    s = lambda c: F.array_join(c.cast("array<string>"), ",")
    ones = F.transform("ids", lambda x: F.lit(1))
    return d.select("session_index", "batch", s(arrays.pad_right(F.col("ids"), size, 0)).alias("input_ids"), s(arrays.pad_right(ones, size, 0)).alias("mask"), s(arrays.pad_right(F.col("ids"), size, -100)).alias("labels"))


@query(f"with {BATCH} select session_index, batch, array_to_string(list_concat([0 for z in range(0, size - len(ids))], ids), ',') as input_ids from b")
def bat2_left_pad(spark, sf):
    d = _batched(spark, sf)
    return d.select("session_index", "batch", F.array_join(arrays.pad_left(F.col("ids"), F.col("size"), 0).cast("array<string>"), ",").alias("input_ids"))


@query("with r as (select session_index, session_index // 8 as batch, [probe_indices[(session_index + j) % len(probe_indices) + 1] for j in range(0, least(len(probe_indices), 3))] as ids from split_index), b as (select *, max(len(ids)) over (partition by batch) as size from r) select session_index, batch, array_to_string(list_concat(ids, [0 for z in range(0, size - len(ids))]), ',') as input_ids from b")
def bat3_rotating_batch(spark, sf):
    rows = arrays.rotating_rows(F.size("ids").cast("bigint"), F.col("session_index"), F.lit(0).cast("bigint"), 3)
    d = _ids(spark, sf).withColumn("batch", F.expr("session_index div 8")).withColumn("r", F.transform(rows, lambda i: F.col("ids")[i.cast("int")]))
    d = d.withColumn("size", F.max(F.size("r")).over(Window.partitionBy("batch")))
    return d.select("session_index", "batch", F.array_join(arrays.pad_right(F.col("r"), F.col("size"), 0).cast("array<string>"), ",").alias("input_ids"))


@query("with r as (select session_index, session_index // 8 as batch, probe_indices as ids from split_index) select batch, array_to_string(flatten(list(ids order by session_index)), ',') as packed, array_to_string(flatten(list(range(0, len(ids)) order by session_index)), ',') as positions from r group by 1")
def bat4_packed(spark, sf):
    d = _ids(spark, sf).withColumn("batch", F.expr("session_index div 8"))
    g = d.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("session_index", "ids"))).alias("g"))
    packed = F.flatten(F.transform("g", lambda r: r["ids"]))
    positions = F.flatten(F.transform("g", lambda r: F.transform(r["ids"], lambda x, i: i)))
    return g.select("batch", F.array_join(packed.cast("array<string>"), ",").alias("packed"), F.array_join(positions.cast("array<string>"), ",").alias("positions"))


@query(f"with {PROBES} select session_id, count(*) filter (prompt is not null and reference is not null) as pairs from p group by 1")
def sup14_prompt_response_pairs(spark, sf):
    """Pairs up to the shorter of two parallel arrays, without nulls on either side."""
    g = _probes(spark, sf).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("probe_index", "prompt", "reference"))).alias("g"))
    z = arrays.zip_shorter(F.col("g.prompt"), F.col("g.reference"))
    return g.select("session_id", F.size(z).cast("bigint").alias("pairs"))


@query("select i, floor(i * 36 / 8)::bigint as layer from (select unnest(range(0, 8)) as i)")
def sup25_layer_pick(spark, sf):
    return spark.range(1).select(F.posexplode(arrays.evenly_spaced(36, 8)).alias("i", "layer")).select(F.col("i").cast("bigint").alias("i"), "layer")


# ---- quality --------------------------------------------------------------------------------------

QWORDS = "list_filter(string_split(trim(regexp_replace({0}, '[\\s\\pZ\\x1c-\\x1f\\x85]+', ' ', 'g')), ' '), lambda w: w <> '')"
BOTH = f"""{PROBES}, {exact.tables()}, {exact.normalized("xa", "p", "probe_index", "prompt")}, {exact.normalized("xb", "p", "probe_index", "reference")},
w as (select probe_index, probe_type, {QWORDS.format('xa.t')} a, {QWORDS.format('xb.t')} b from p join xa using (probe_index) join xb using (probe_index))"""
F1 = f"""{BOTH},
f as (select *, list_sum([least(len([1 for v in a if v = x]), len([1 for v in b if v = x])) for x in list_distinct(a)]) c from w),
q as (select probe_index, probe_type, case when len(a) + len(b) = 0 then 1.0 else 2.0 * coalesce(c, 0) / (len(a) + len(b)) end as f1, a = b as exact, len(b) = 0 as empty from f)"""


def _scored(spark, sf):
    p = _probes(spark, sf)
    a, b = F.col("prompt"), F.col("reference")
    x, y = text.quality_normalize(a), text.quality_normalize(b)
    return p.select("probe_index", "probe_type", quality.token_f1(a, b).alias("f1"), (x == y).alias("exact"), (y == "").alias("empty"))


@query(f"with {F1} select probe_index, round(f1, 6) as f1 from q")
def scl27_token_f1(spark, sf):
    return _scored(spark, sf).select("probe_index", F.round("f1", 6).alias("f1"))


@query(f"""with recursive {BOTH}, l as (select probe_index, a, b, 0 as i, list_transform(range(0, len(b) + 1), lambda k: 0) as row from w union all
select probe_index, a, b, i + 1, list_reduce(list_prepend([0], list_transform(range(1, len(b) + 1), lambda j: case when b[j] = a[i + 1] then [row[j] + 1] else [row[j + 1]] end)), lambda s, v: list_append(s, greatest(s[len(s)], v[1]))) from l where i < len(a))
select probe_index, round(case when len(a) + len(b) = 0 then 1.0 else 2.0 * row[len(row)] / (len(a) + len(b)) end, 6) as rouge_l from l where i = len(a)""")
def scl28_rouge_l(spark, sf):
    return _probes(spark, sf).select("probe_index", F.round(quality.rouge_l(F.col("prompt"), F.col("reference")), 6).alias("rouge_l"))


@query(f"with {F1} select probe_type, count(*) as n, round(avg(exact::int), 6) as exact_match, round(sum(f1) / count(*), 6) as token_f1, round(avg(empty::int), 6) as empty_rate from q group by 1")
def agg6_quality_summary(spark, sf):
    s = quality.summarize(_scored(spark, sf), ["probe_type"])
    return s.select("probe_type", "n", *[F.round(c, 6).alias(c) for c in ("exact_match", "token_f1", "empty_rate")])


# ---- aggregates -----------------------------------------------------------------------------------


@query("""with s as (select session_id, min(source) source, min(domain) as domain, min(context_tokens)::bigint t from sessions group by 1)
select source, domain, count(*) as sessions, coalesce(sum(t), 0)::bigint as tokens from s group by grouping sets ((source), (domain), ())""")
def agg1_counts(spark, sf):
    s = table(spark, sf, "sessions").groupBy("session_id").agg(F.min("source").alias("source"), F.min("domain").alias("domain"), F.min("context_tokens").cast("bigint").alias("t"))
    return s.groupingSets([["source"], ["domain"], []], "source", "domain").agg(F.count("*").alias("sessions"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens")).select("source", "domain", "sessions", "tokens")


@query("""select k as tokenizer, sum(v)::bigint as total, max(v) as largest from (select unnest(map_keys(m)) k, unnest(map_values(m)) v from (select from_json(c, '{"words": "BIGINT"}') s, map {'words': (c->>'$.words')::bigint} as m from (select session_id, min(context_token_counts_json) c from sessions group by 1) where c is not null)) group by 1""")
def agg2_token_counts(spark, sf):
    c = table(spark, sf, "sessions").groupBy("session_id").agg(F.min("context_token_counts_json").alias("c"))
    m = c.select(F.explode(F.from_json("c", "map<string,bigint>")).alias("tokenizer", "v"))
    return m.groupBy("tokenizer").agg(F.sum("v").alias("total"), F.max("v").alias("largest"))


@query("""with d as (select session_id, h, (row_number() over (order by session_id, h) - 1) // 4096 as block from (select distinct session_id, sha256(coalesce(context, '')) as h from sessions)),
b as (select block, sha256(string_agg(h, '' order by session_id, h)) as h from d group by 1) select case when count(*) = 1 then min(h) else sha256(string_agg(h, '' order by block)) end as digest from b""")
def agg3_content_digest(spark, sf):
    d = table(spark, sf, "sessions").select("session_id", F.sha2(F.coalesce("context", F.lit("")), 256).alias("h")).distinct()
    return indexing.ordered_digest(d, ["session_id", "h"], "h")


@query("""with s as (select session_id, min(session_index) i, max(context_token_max)::bigint t from sessions group by 1), k as (select *, case when ('0x' || substr(sha256(concat_ws(chr(0), '42', session_id)), 1, 16))::ubigint::double / 18446744073709551616.0 < 0.01 then 'validation' else 'train' end as split from s),
r as (select *, row_number() over (partition by split order by t desc nulls last, i) as rank from k) select split, session_id, t as tokens, rank from r where rank <= 256""")
def agg4_longest_contexts(spark, sf):
    """The 256 longest contexts of each split: the report's size is its feature."""
    s = table(spark, sf, "sessions").groupBy("session_id").agg(F.min("session_index").alias("i"), F.max("context_token_max").cast("bigint").alias("tokens"))
    return indexing.longest(splits.session_split(s), ["split"], "tokens", "i", 256).select("split", "session_id", "tokens", "rank")


@query(f"""with {DISTINCT_EVENTS}, l as (select session_id, role, length(coalesce(content, '')) as v from e), r as (select session_id, role, avg(v) m from l group by 1, 2) select session_id, round(avg(m), 6) as mean_loss from r group by 1""")
def agg5_mean_of_means(spark, sf):
    l = events(spark, sf).select("session_id", "role", F.length(F.coalesce("content", F.lit(""))).alias("v"))
    return quality.mean_of_means(l, ["session_id", "role"], "v").select("session_id", F.round("mean_loss", 6).alias("mean_loss"))


@query("select event_type, round(sum(value) / count(value), 6) as mean, count(*) as n from events group by 1")
def agg7_window_metric(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum("value") / F.count("value"), 6).alias("mean"), F.count("*").alias("n"))


@query("select benchmark, lang, count(*) as n, round(avg((length(correct_answer) % 3 = 0)::int), 6) as accuracy from eval_items group by grouping sets ((benchmark), (lang), ())")
def agg8_accuracy(spark, sf):
    e = table(spark, sf, "eval_items").withColumn("c", (F.length("correct_answer") % 3 == 0).cast("int"))
    return e.groupingSets([["benchmark"], ["lang"], []], "benchmark", "lang").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("accuracy")).select("benchmark", "lang", "n", "accuracy")


@query("with u as (select benchmark, persona_id, avg((length(correct_answer) % 3 = 0)::int) a from eval_items group by 1, 2) select benchmark, count(*) as users, round(avg(a), 6) as macro_mean, round(stddev_pop(a), 6) as macro_std from u group by 1")
def agg9_macro_mean(spark, sf):
    e = table(spark, sf, "eval_items").withColumn("c", F.length("correct_answer") % 3 == 0)
    m = benchmarks.macro_summary(e, "persona_id", "benchmark", "c")
    return m.select("benchmark", "users", F.round("macro_mean", 6).alias("macro_mean"), F.round("macro_std", 6).alias("macro_std"))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def agg10_percentiles(spark, sf):
    p = benchmarks.linear_percentiles(table(spark, sf, "events"), "event_type", "value")
    return p.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("with s as (select source, list(context_tokens order by context_tokens) v from sessions where context_tokens is not null group by 1) select source, v[round_even(0.95 * (len(v) - 1), 0)::int + 1] as p95 from s")
def agg11_nearest_rank(spark, sf):
    return benchmarks.nearest_rank(table(spark, sf, "sessions"), "source", "context_tokens", 0.95, "p95")


@query("""select metric, count(v) as n, round(avg(v), 6) as mean, round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.95), 6) as p95, min(v) as least, max(v) as most from (
select 'context_tokens' as metric, context_tokens::double v from sessions union all select 'context_token_max', context_token_max from sessions union all select 'probe_count', probe_count from sessions) group by 1""")
def agg12_performance_summary(spark, sf):
    cols = ["context_tokens", "context_token_max", "probe_count"]
    s = table(spark, sf, "sessions").select(*[F.col(c).cast("double") for c in cols]).unpivot([], cols, "metric", "v")
    r = lambda c, n: F.round(c, 6).alias(n)
    return s.groupBy("metric").agg(F.count("v").alias("n"), r(F.avg("v"), "mean"), r(F.percentile("v", 0.5), "p50"), r(F.percentile("v", 0.95), "p95"), F.min("v").alias("least"), F.max("v").alias("most"))


@query("select session_index, coalesce(list_sum(probe_indices), 0)::bigint as total, list_max(probe_indices) as largest from split_index")
def agg13_selected_sum(spark, sf):
    return _ids(spark, sf).select("session_index", F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_max("ids").alias("largest"))


@query("select count(*)::bigint as ids, sum(n)::bigint as rows, count_if(n > 1)::bigint as duplicated, coalesce(sum(n) filter (n > 1), 0)::bigint as occurrences from (select session_id, count(*) n from sessions group by 1)")
def agg14_duplicate_ids(spark, sf):
    c = table(spark, sf, "sessions").groupBy("session_id").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("ids"), F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("duplicated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("occurrences"))


@query("select reason, lower(trim(source)) as source, coalesce(nullif(detail, ''), '-') as detail, count(*) as n from (select distinct * from rejections) group by 1, 2, 3")
def agg15_value_counts(spark, sf):
    r = table(spark, sf, "rejections").distinct()
    return r.groupBy("reason", F.lower(F.trim("source")).alias("source"), F.coalesce(F.nullif("detail", F.lit("")), F.lit("-")).alias("detail")).agg(F.count("*").alias("n"))


@query("select session_index % 5 as epoch, count(*) as steps, count_if(len(probe_indices) <= 1) as skipped, round(sum(case when len(probe_indices) > 1 then len(probe_indices) else 0 end) / count(*), 6) as mean_loss from split_index group by 1")
def agg16_epoch_losses(spark, sf):
    n = F.size("ids")
    return _ids(spark, sf).groupBy((F.col("session_index") % 5).alias("epoch")).agg(F.count("*").alias("steps"), F.count_if(n <= 1).alias("skipped"), F.round(F.sum(F.when(n > 1, n).otherwise(0)) / F.count("*"), 6).alias("mean_loss"))


# ---- memory ---------------------------------------------------------------------------------------

GATE = memory.INIT_GATE


@query(f"""with r as (select label, vec_id, embedding, row_number() over (partition by label order by vec_id desc) - 1 as back, count(*) over (partition by label) as n from embeddings),
t as (select label, n, unnest(embedding::double[]) x, unnest(range(0, 64)) i, case when back = n - 1 then pow({GATE}, back) else (1 - {GATE}) * pow({GATE}, back) end as w from r)
select label, i::bigint as i, max(n) - 1 as updates, round(sum(x * w), 6) as h from t group by 1, 2""")
def st9_memory_fold(spark, sf):
    m = memory.fold_by_user(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return m.select("label", F.col("i").cast("bigint").alias("i"), "updates", F.round("h", 6).alias("h"))


@query(f"""with r as (select label, embedding, row_number() over (partition by label order by vec_id desc) - 1 as back from embeddings),
t as (select label, unnest(embedding::double[]) x, unnest(range(0, 64)) i, (1 - {GATE}) * pow({GATE}, back) as w from r) select label, i::bigint as i, round(sum(x * w), 6) as h from t group by 1, 2""")
def st9_zero_state_fold(spark, sf):
    m = memory.fold_by_user(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", zero_state=True)
    return m.select("label", F.col("i").cast("bigint").alias("i"), F.round("h", 6).alias("h"))


@query("select vec_id, vec_id // 12 as epoch, vec_id % 12 as batch from embeddings")
def st14_epoch_position(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.expr("vec_id div 12").alias("epoch"), (F.col("vec_id") % 12).alias("batch"))


@query("select label, count(*) as n, case when count(*) = 1 then 1 else 0 end as skipped from embeddings group by 1")
def sup22_gate_skip(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.when(F.count("*") == 1, 1).otherwise(0).alias("skipped"))
