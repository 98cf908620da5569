"""SQL of the queries that SQL can express, by brute force over whole tables."""

from __future__ import annotations

from sessionloom.queries import exact

_LEAKS = f"""with {exact.tables()}, {exact.normalized("nd", "documents", "doc_id", "text")},
i as (select row_number() over () as k, item_id, x from (select item_id, passage as x from eval_items union all select item_id, user_query from eval_items) where item_id is not null), {exact.normalized("ni", "i", "k", "x")},
wd as (select doc_id, regexp_extract_all(t, '[\\pL\\pN]+') as w from nd), wi as (select item_id, regexp_extract_all(t, '[\\pL\\pN]+') as w from ni join i using (k)),
d as (select distinct doc_id, array_to_string(w[n:n + 11], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 10)) as n from wd where len(w) >= 12)),
m as (select distinct item_id, array_to_string(w[n:n + 11], ' ') as s from (select item_id, w, unnest(range(1, len(w) - 10)) as n from wi where len(w) >= 12)),
hits as (select doc_id, item_id, count(*) as windows from d join m using (s) group by 1, 2), sizes as (select item_id, count(*) as n from m group by 1)"""

_PAIRS = f"""with recursive e as (select session_id, event_id, arg_min(content, struct_pack(a := coalesce(event_index, -1), c := content)) as content, min(coalesce(event_index, -1)) as event_index from session_events where session_id is not null and content is not null and content <> '' group by 1, 2),
s as (select session_id, string_agg(content, chr(10) order by event_index, event_id nulls first) as x from e group by 1), {exact.tables()}, {exact.normalized("ns", "s", "session_id", "x")},
w as (select session_id, {exact.words("t")} as w from ns),
h as (select distinct session_id, array_to_string(w[n:n + 2], ' ') as g from (select session_id, w, unnest(range(1, len(w) - 1)) as n from w where len(w) >= 3)),
z as (select session_id, count(*) as n from h group by 1), met as (select a.session_id as p, b.session_id as q, count(*) as c from h a join h b on a.g = b.g and a.session_id < b.session_id group by 1, 2),
pairs as (select p, q from met join z x on x.session_id = p join z y on y.session_id = q where c >= 0.7 * (x.n + y.n - c))"""

ORACLE = {
    "p5_found": _PAIRS + " select p as session_id_a, q as session_id_b from pairs",
    "p5_groups": _PAIRS
    + """, links as (select p as u, q as v from pairs union all select q, p from pairs), reach as (select u, u as v from links union select r.u, l.v from reach r join links l on l.u = r.v),
g as (select u, min(v) as group_id from reach group by 1), n as (select u, count(*) as links from links group by 1) select u as session_id, group_id, links from g join n using (u)""",
    "p7_found": _LEAKS + " select doc_id, item_id from hits",
    "p7_leaked_items": _LEAKS + " select item_id, count(*) as n_docs, max(windows / n) as max_containment from hits join sizes using (item_id) group by 1",
}
