"""Operators of the corpus pipeline on small frames, and the registered queries against their SQL."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import arrays, text
from sessionloom.operators import adapters, budget, canonical, dedup, filters, indexing, probes, quality, segment, splits, store
from sessionloom.sources import readers, writers


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return df.select(column.alias("r")).first()["r"]


def test_normalize_exact_and_native(spark):
    rows = [("Straße Foo_1!",), ("ﬁ Ａ",), (None,), ("",), ("é x",)]
    got = spark.createDataFrame(rows, "t string").select(text.normalize_exact(F.col("t")).alias("e"), text.normalize(F.col("t")).alias("n")).collect()
    assert [r.e for r in got] == ["strasse foo_1", "fi a", "", "", "é x"]
    assert got[0].n == "strasse foo_1" and got[2].n == ""


def test_simhash_edges():
    assert text.simhash_of([]) == 0
    a, b = text.simhash_of("a b".split()), text.simhash_of("a b c".split())
    assert a != b and -(2**63) <= a < 2**63


def test_dense_index_and_running_sum(spark):
    rows = [(i, random.Random(i).randrange(9)) for i in range(500)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = {r.k: r for r in indexing.running_sum(indexing.dense_index(df, ["k"], "i"), ["k"], F.col("v"), "s").collect()}
    total = 0
    for i, (k, v) in enumerate(sorted(rows)):
        assert (got[k].i, got[k].s) == (i, total)
        total += v
    assert indexing.dense_index(df.limit(0), ["k"], "i").count() == 0


def greedy_reference(rows, caps, distance=3):
    used, accepted, hashes, out = {}, [], set(), {}
    for pos, domain, tokens, h, sim, words in sorted(rows):
        if used.get(domain, 0) + tokens > caps[domain]:
            out[pos] = "domain_token_budget"
        elif h in hashes:
            out[pos] = "exact_duplicate"
        elif words >= 20 and any(bin((sim ^ o) & (2**64 - 1)).count("1") <= distance for o in accepted):
            out[pos] = "near_duplicate"
        else:
            out[pos] = "accepted"
            used[domain] = used.get(domain, 0) + tokens
            hashes.add(h)
            if words >= 20:
                accepted.append(sim)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_budget_and_dedup_equal_a_scan(spark, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = []
    for i in range(60):
        sim = rng.choice(base)
        for _ in range(rng.randrange(4)):
            sim ^= 1 << rng.randrange(62)
        rows.append((i, rng.choice("ab"), rng.randrange(1, 40), f"h{rng.randrange(40)}", sim, rng.choice([5, 30])))
    caps = {"a": 300, "b": 200}
    df = spark.createDataFrame(rows, "pos long, domain string, tokens long, h string, sim long, w int")
    got = {r.pos: r.reason for r in budget.accept(df, caps, "pos", "domain", "tokens", "h", "sim", "w").collect()}
    assert got == greedy_reference(rows, caps)


def test_near_duplicates_are_not_components(spark):
    # a ~ b ~ c, while a and c differ: b is rejected, c is not
    a, b, c = 0, 0b111, 0b111111
    df = spark.createDataFrame([(0, "x", a, 20), (1, "y", b, 20), (2, "z", c, 20), (3, "q", b, 19)], "i long, h string, s long, w int")
    got = {r.i: r.verdict for r in dedup.classify(df, "i", "h", "s", "w").collect()}
    assert got == {0: "accepted", 1: "near_duplicate", 2: "accepted", 3: "accepted"}
    edges = dedup.candidate_pairs(df.where("w >= 20"), "i", "s")
    assert {(r.a, r.b) for r in edges.collect()} == {(0, 1), (1, 2)}
    assert {r.id for r in dedup.greedy_rejections(edges).collect()} == {1}


@pytest.mark.parametrize("seed", [3, 4])
def test_duplicates_equal_a_scan(spark, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(63) for _ in range(8)]
    sims, rows = {}, []
    for i in range(150):
        h, sim = f"h{rng.randrange(60)}", rng.choice(base)
        for _ in range(rng.randrange(4)):
            sim ^= 1 << rng.randrange(62)
        sim, words = sims.setdefault(h, (sim, rng.choice([5, 30])))
        rows.append((i, h, sim, words))
    kept, want = [], {}
    for i, h, sim, words in rows:
        if any(h == o[1] for o in kept):
            want[i] = "exact_duplicate"
        elif words >= 20 and any(o[3] >= 20 and bin(sim ^ o[2]).count("1") <= 3 for o in kept):
            want[i] = "near_duplicate"
        else:
            want[i] = "accepted"
            kept.append((i, h, sim, words))
    got = {r.i: r.verdict for r in dedup.classify(spark.createDataFrame(rows, "i long, h string, s long, w int"), "i", "h", "s", "w").collect()}
    assert got == want


def test_group_positions_and_longest(spark):
    from sessionloom.operators import benchmarks, indexing

    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), (None, 7), ("a", 2), (None, 5)], "g string, v int")
    got = {(r.g, r.v): r.i for r in indexing.group_index(df, ["g"], ["v"], "i").collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("b", 1): 0, (None, 5): 0, (None, 7): 1}
    assert {(r.g, r.v, r["rank"]) for r in indexing.longest(df, ["g"], "v", "v", 1).collect()} == {("a", 3, 1), ("b", 1, 1), (None, 7, 1)}
    assert indexing.group_index(df.limit(0), ["g"], ["v"], "i").count() == 0
    parts = {r.g: r.part for r in benchmarks.topic_split(df.select("g").distinct(), "g", 1, 1).collect()}
    assert sorted(parts.values()) == ["test", "train", "train"] and parts[None] == "train"


def test_stored_rows_are_checked(spark):
    from sessionloom.operators import objectives

    student = [float(x) for x in (-0.5, -1.5, -2.0)]
    df = lambda ids, lps: spark.createDataFrame([(student, ids, lps)], "s array<double>, i array<int>, t array<double>").select(objectives.stored_forward_kl(F.col("s"), F.col("i"), F.col("t")).alias("x"))
    import math

    p = [0.7 / 1.005, 0.305 / 1.005]
    want = sum(a * (math.log(a) - b) for a, b in zip(p, student))
    assert df([0, 1], [math.log(0.7), math.log(0.305)]).first().x == pytest.approx(want)
    assert df(None, None).first().x is None
    for ids, lps in (([0, 0], [-1.0, -1.0]), ([0, 1], [math.log(0.8), math.log(0.3)]), ([], []), ([0], [math.nan])):
        with pytest.raises(Exception, match="repeated|mass|empty|finite"):
            df(ids, lps).collect()


def test_providers_are_denied_by_default(spark):
    said = ['{"external_api_allowed": true}', '{"external_api_allowed": false}', "{}", None, "no json", '{"external_api_allowed": 0}', '{"external_api_allowed": null}', '{"external_api_allowed": "yes"}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(said)], "i int, p string")
    got = {r.i: (r.a, r.b) for r in df.select("i", filters.external_allowed(F.col("p"), "openai").alias("a"), filters.external_allowed(F.col("p"), "own").alias("b")).collect()}
    assert {i for i, (a, _) in got.items() if a} == {0, 7} and all(b for _, b in got.values())


def test_budget_skips_and_takes_smaller_rows(spark):
    df = spark.createDataFrame([(0, "a", 5), (1, "a", 90), (2, "a", 4), (3, "a", 2), (4, "b", 1), (5, "a", None)], "i long, d string, t long")
    assert {r.i for r in budget.greedy(df, {"a": 10}, "d", "i", "t").collect()} == {0, 2, 5}
    assert budget.caps(100, {"b": 0.5, "a": 0.335}) == {"a": 33, "b": 67}


MESSAGE = "record_id string, messages array<struct<role:string,content:string,name:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>>"


def test_messages_pair_results_by_id_else_in_order(spark):
    call = lambda i, n: {"id": i, "name": n, "arguments": "{}"}
    rows = [
        ("r", [
            {"role": "system", "content": "s"}, {"role": "human", "content": " hi "},
            {"role": "assistant", "content": "dropped", "tool_calls": [call("1", "a"), call("2", "b"), call("3", "Secret")]},
            {"role": "tool", "content": "of b", "tool_call_id": "2"}, {"role": "tool", "content": "of a", "tool_call_id": "unknown"},
            {"role": "tool", "content": "gone", "tool_call_id": "3"},
        ]),
        ("u", [{"role": "alien", "content": "x"}]),
        ("n", []),
    ]
    full = [(r, [{k: m.get(k) for k in ("role", "content", "name", "tool_call_id", "tool_calls")} for m in ms]) for r, ms in rows]
    out = {r.session_id: r for r in adapters.adapt(spark.createDataFrame(full, MESSAGE), "tool_messages", "src", "d", excluded_tools=("secret",)).collect()}
    events = out["src:r"].events
    assert [(e.id, e.type, e.name, e.content) for e in events] == [
        ("e0", "message", "", "hi"), ("e1", "tool_call", "a", ""), ("e2", "tool_call", "b", ""), ("e3", "tool_result", "b", "of b"), ("e4", "tool_result", "a", "of a"),
    ]
    assert [p.reference for p in out["src:r"].probes] == ["of b", "of a"]
    assert out["src:u"].reject == "unknown_role" and out["src:n"].reject == "no_events"


def test_other_adapters(spark):
    fixed = spark.createDataFrame([("a", " ctx ", ["p"], ["r"]), ("b", "", ["p"], ["r"]), ("c", "x", ["p"], [])], "record_id string, context string, prompts array<string>, responses array<string>")
    got = {r.session_id: r for r in adapters.adapt(fixed, "fixed_trajectory", "s", "d").collect()}
    assert got["s:a"].events[0].content == "ctx" and got["s:a"].probes[0].evidence_event_ids == ["e0"]
    assert (got["s:b"].reject, got["s:c"].reject) == ("empty_context", "length_mismatch")
    swe = spark.createDataFrame([("t", json.dumps([{"role": "user", "content": "fix"}])), ("bad", "no json")], "record_id string, trajectory string")
    got = {r.session_id: r.reject for r in adapters.adapt(swe, "swe_zero", "s", "coding").collect()}
    assert got["s:t"] is None and got["s:bad"] is not None
    turns = [{"speaker": "USER", "utterance": "book", "frames": [{"service": "svc", "state": {"active_intent": "Book", "slot_values": {"slot_name": ["day", "x"], "slot_value_list": [["mon", "tue"], []]}}, "service_call": {"method": "Find", "parameters": {"city": "Rome"}}, "service_results": [{"id": 7}, {}]}]}]
    by_field = {"speaker": ["USER"], "utterance": ["book"], "frames": [turns[0]["frames"]]}
    dialog = spark.createDataFrame([("g", json.dumps(turns)), ("h", json.dumps(by_field)), ("i", "no json"), ("j", None)], "record_id string, turns string")
    rows = {r.session_id: r for r in adapters.adapt(dialog, "schema_guided_dialog", "s", "tool", {"license": "MIT"}).collect()}
    row = rows["s:g"]
    assert [(e.id, e.type, e.name) for e in row.events] == [("e0", "message", ""), ("e1", "state_change", ""), ("e2", "tool_call", "svc.Find"), ("e3", "tool_result", "svc")]
    assert json.loads(row.events[1].content)["active_intent"] == "Book" and row.events[2].arguments == '{"city":"Rome"}'
    assert [(a.key, a.type, a.value, a.evidence_event_ids) for a in row.memory_atoms] == [("svc.day", "task_state", "mon, tue", ["e1"]), ("svc.method", "tool_call", "Find", ["e2"]), ("svc.id", "tool_outcome", "7", ["e3"])]
    assert [p.prompt for p in row.probes] == ["What value is stored for day in svc?", "Which service method was called for svc?", "What value did svc return for id?"]
    assert rows["s:h"].events == row.events and (rows["s:i"].reject, rows["s:j"].reject) == ("bad_json", "no_events")
    assert json.loads(row.provenance) == {"license": "MIT", "revision": "", "external_api_allowed": False, "source_record_id": "g"}
    nested = spark.createDataFrame([("g", [("USER", "hi", [("svc", {"a": "1"})])])], "record_id string, turns array<struct<speaker:string,utterance:string,frames:array<struct<service:string,service_results:map<string,string>>>>>")
    assert [a.value for a in adapters.adapt(nested, "schema_guided_dialog", "s", "tool").first().memory_atoms] == ["1"]
    steps = [{"role": "user", "content": "fix"}, {"role": "assistant", "content": "thinking", "tool_calls_json": json.dumps([{"id": "c1", "function": {"name": "run", "arguments": {"b": 1, "a": 2}}}])}, {"role": "tool", "content": "ok", "tool_call_id": "c1"}, {"role": "assistant", "function_call": {"name": "ls"}}, {"role": "tool", "content": "files"}]
    coding = adapters.adapt(spark.createDataFrame([("t", json.dumps(steps), "org/r")], "record_id string, trajectory string, repo string"), "swe_zero", "s", "coding").first()
    assert [(e.id, e.type, e.name, e.arguments) for e in coding.events] == [("e0", "message", "", None), ("e1", "tool_call", "run", '{"a":2,"b":1}'), ("e2", "tool_result", "run", None), ("e3", "tool_call", "ls", "{}"), ("e4", "tool_result", "ls", None)]
    assert [(p.prompt, p.reference) for p in coding.probes] == [("What result did the coding environment return for tool call c1?", "ok"), ("What result did the coding environment return for tool call e3?", "files")]
    assert [a.key for a in coding.memory_atoms] == ["c1", "e3"] and json.loads(coding.provenance)["repository"] == "org/r" and coding.reject is None
    ids = spark.createDataFrame([("d", [1, 2], [[3, 4, 5], [6], [7, 8]], [[1, 9], [0, 1], [2, 1]]), ("e", None, None, None)], "record_id string, ctx_ids array<int>, input_ids array<array<int>>, response_start_end array<array<int>>")
    got = {r.session_id: r for r in adapters.adapt(ids, "d2l_tokenized", "s", "d", decode=lambda own: " ".join(f"t{i}" for i in own)).collect()}
    assert got["s:d"].events[0].content == "t1 t2" and [(p.prompt, p.reference) for p in got["s:d"].probes] == [("t3", "t4 t5")] and got["s:e"].reject == "empty_context"
    tm = spark.createDataFrame([("m", [("USER", "two seats", [("two", [("seats",)])])])], "record_id string, utterances array<struct<speaker:string,text:string,segments:array<struct<text:string,annotations:array<struct<name:string>>>>>>")
    assert adapters.adapt(tm, "taskmaster", "s", "tool").first().memory_atoms[0].value == "two"
    with pytest.raises(ValueError):
        adapters.adapt(tm, "nothing", "s", "d")


def test_validation_order(spark):
    events = json.dumps([{"id": "e0", "role": "user", "content": "x"}, {"id": "e0", "role": "pilot", "content": ""}])
    df = spark.createDataFrame([("s", events), ("t", None), ("u", '[{"id":"e0","role":"user","content":"y"}]')], "session_id string, j string").withColumn("events", canonical.parse_events(F.col("j")))
    got = [r[0] for r in df.select(canonical.first_error(F.col("session_id"), F.col("events"))).collect()]
    assert got == ["duplicate_event_id", "events", None]


def test_segments_cover_all_events(spark):
    events = [{"id": f"e{i}", "role": "user", "type": "message", "content": "w " * (5 + 7 * i % 11), "name": "", "arguments": None, "status": ""} for i in range(12)]
    parts = segment.segments_of("[h]", events, 40)
    assert {e["id"] for g, _ in parts for e in g} == {e["id"] for e in events}
    assert all(n <= 40 for _, n in parts)
    big = [events[0] | {"content": "w " * 500}]
    (group, n), = segment.segments_of("[h]", big, 40)
    assert n <= 40 and group[0]["content"].endswith("[truncated]")
    assert segment.segments_of("[h]", [], 40) == [] and len(segment.segments_of("[h]", events, 0)) == 1


def test_probe_repair_and_merge():
    assert probes.repair_json('```json\n{"probes": [{"prompt": "a",}]}\n```') == {"probes": [{"prompt": "a"}]}
    assert probes.repair_json('{"p": [["q", "r", ["e0"]], ["cut') == [["q", "r", ["e0"]]]
    assert probes.repair_json("nothing") is None and probes.repair_json(None) is None
    have = [{"id": "g_p0", "prompt": "Q", "reference": "R"}]
    new = probes.merge_payload(have, '{"probes": [{"prompt": "q ", "reference": "r", "evidence_event_ids": ["e0"]}, {"prompt": "n", "reference": "x", "evidence_event_ids": ["e0", "zz"]}, {"prompt": "o", "evidence_event_ids": []}]}', {"e0"})
    assert [(p["id"], p["prompt"]) for p in new] == [("g_p0", "Q"), ("g_p1", "n")]


def test_read_join_errors(spark):
    index = spark.createDataFrame([(0, "a", [1, 0]), (1, "b", []), (2, "c", [9])], "session_index long, session_id string, probe_indices array<long>")
    sessions = spark.createDataFrame([(0, "a", "ctx"), (0, "a", "ctx"), (1, "x", None)], "session_index long, session_id string, context string")
    p = spark.createDataFrame([(0, "a", "p0", "r0", True), (1, "z", "p1", "", True)], "probe_index long, session_id string, prompt string, reference string, answerable boolean")
    got = {r.session_index: r for r in store.read_samples(index, sessions, p).collect()}
    assert got[0].prompts == ["p1", "p0"] and set(got[0].errors) == {"foreign_probe", "blank_reference"}
    assert set(got[1].errors) == {"empty_selection", "id_mismatch"} and "missing_probe" in got[2].errors


def test_quality(spark):
    df = spark.createDataFrame([("A b b", "b c"), ("", ""), ("x", None)], "a string, b string")
    got = df.select(quality.token_f1(F.col("a"), F.col("b")).alias("f"), quality.rouge_l(F.col("a"), F.col("b")).alias("r")).collect()
    assert [round(r.f, 3) for r in got] == [0.4, 1.0, 0.0] and [round(r.r, 3) for r in got] == [0.4, 1.0, 0.0]


def test_arrays(spark):
    got = one(spark, arrays.find_sub(F.col("a"), F.col("b")), a=[1, 2, 3, 2, 3], b=[2, 3])
    assert got == 1
    assert one(spark, arrays.truncate_keep_span(F.col("a"), F.lit(1), F.lit(3), 2), a=[1, 2, 3, 4]) == [2, 3]
    assert one(spark, arrays.response_mask(F.col("a"), [7]), a=[1, 7, 3]) == [1, 1, 0]


def test_filters(spark):
    df = spark.createDataFrame([("/Org/Repo/",), ("x",), (None,)], "k string")
    barred = spark.createDataFrame([("org/repo",)], "r string")
    got = {r.k: r.reject for r in filters.excluded(df, F.col("k"), barred, "r", "gone").collect()}
    assert got == {"/Org/Repo/": "gone", "x": None, None: None}
    assert one(spark, filters.flagged(F.col("j")), j='{"a":{"flagged":[false, true]}}')
    assert one(spark, filters.too_long(F.create_map(F.lit("b"), F.lit(9), F.lit("a"), F.lit(8)), 5)) == "a=8, b=9"


def test_splits_keep_one_probe_for_training(spark):
    p = spark.createDataFrame([(i, "s", f"p{i}") for i in range(2)] + [(9, "t", "p")], "probe_index long, session_id string, probe_id string")
    got = splits.held_out_probes(p).groupBy("session_id").agg(F.count_if("held_out").alias("n")).collect()
    assert {r.session_id: r.n for r in got} == {"s": 1, "t": 0}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "b.json").write_text('[{"x": 1}, {"x": 2}, {"x": 3}]')
    assert readers.read_records(spark, readers.expand_paths(["*.jsonl"], str(tmp_path))).count() == 2
    assert readers.read_records(spark, [str(tmp_path / "b.json")]).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.expand_paths(["*.none"], str(tmp_path))
    (tmp_path / "l.txt").write_text("a.jsonl # first\n\nb.json\n")
    assert len(readers.sample_paths([str(tmp_path / "l.txt")])) == 2
    (tmp_path / "c.csv").write_text('a,b\n1,"two\nlines"\n')
    assert readers.read_csv(spark, str(tmp_path / "c.csv"), ["a", "b"]).first()["b"] == "two\nlines"
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "c.csv"), ["z"])
    (tmp_path / "h.json").write_text(json.dumps({"metadata": {"persona_id": "p", "total_messages": 2}, "chat_history": [{"role": "user", "content": "a"}, {"role": "user", "content": " "}]}))
    h = readers.read_histories(spark, [str(tmp_path / "h.json")]).first()
    assert (h.persona_id, h.dropped, h.error) == ("p", 1, None)
    out = str(tmp_path / "shards")
    writers.write_shards(spark.range(100).withColumnRenamed("id", "i"), out, "i", 30)
    manifest = writers.write_manifest(spark, {"t": out}, str(tmp_path / "m.json"))
    assert manifest["t"]["rows"] == 100 and manifest["t"]["files"] >= 4
    store_path = str(tmp_path / "teacher")
    assert writers.append_new(spark.range(5), store_path, "id") == 5 and writers.append_new(spark.range(8), store_path, "id") == 8


def test_build_end_to_end(spark, tmp_path):
    from sessionloom.plans import pipeline

    body = [("s%d" % i, "d", "src", i, "words of session number %d and more" % (i if i != 3 else 2)) for i in range(6)]
    rows = spark.createDataFrame(body, "session_id string, domain string, source string, position long, c string")
    event = "array(named_struct('id','e0','role','user','type','message','content',c,'name','','arguments',cast(null as string),'status','','timestamp','','metadata',cast(null as string)))"
    probe = "array(named_struct('id','p0','prompt','q','probe_type','t','reference','r','split','','metadata',cast(null as string),'answerable',true,'evidence_event_ids',array('e0')))"
    config = pipeline.BuildConfig(10_000, {"d": 1.0})
    tables = pipeline.build(rows.withColumn("events", F.expr(event)).withColumn("probes", F.expr(probe)), config)
    manifest = pipeline.publish(spark, tables, str(tmp_path), config)
    assert manifest["sessions"]["rows"] == 5 and manifest["probes"]["rows"] == 5
    assert [r.reason for r in tables["rejections"].collect()] == ["exact_duplicate"]
    assert [r.session_index for r in spark.read.parquet(f"{tmp_path}/sessions").orderBy("session_index").collect()] == list(range(5))


def test_memory_stream_equals_fold(spark, tmp_path):
    from sessionloom.operators import memory
    from sessionloom.streaming.memory import fold_stream

    rows = [("u%d" % (i % 2), i, [float(i), 1.0]) for i in range(8)]
    schema = "user_id string, position long, latent array<double>"
    src = tmp_path / "in"
    for k in range(2):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], schema).coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).json(str(src))
    q = fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.user_id: r for r in spark.table("folded").collect()}
    want = memory.fold_by_user(spark.createDataFrame(rows, schema), "user_id", "position", "latent").collect()
    for r in want:
        assert abs(got[r.user_id].state[r.i] - r.h) < 1e-9 and got[r.user_id].updates == 4
    direct = spark.createDataFrame([([[1.0], [2.0]],)], "s array<array<double>>").select(memory.fold(F.col("s")).alias("h")).first().h
    assert abs(direct[0] - (memory.INIT_GATE + 2 * (1 - memory.INIT_GATE))) < 1e-12


def test_registered_queries_have_sql_columns():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_seeded_functions():
    import random as standard

    from sessionloom.functions import seeded
    from sessionloom.operators import benchmarks

    places = list(range(5))
    standard.Random(seeded.digest_seed("i1")).shuffle(places)
    assert seeded.order_of("i1", 5) == places and sorted(places) == list(range(5))
    one, again = (seeded.epoch_order(["b", "a"], {"a": 3, "b": 2}, 1, e) for e in (0, 0))
    assert one == again and sorted(g for g, _ in one) == ["a", "b"]
    seeds = {seeded.mixed_seed(42, i, j, v) for i in range(3) for j in range(3) for v in (0, 1)}
    assert len(seeds) == 18 and all(0 <= s < 2**63 for s in seeds)
    assert seeded.canonical_json('{"b": 1, "a": "é"}') == '{"a":"é","b":1}' and seeded.canonical_json(" no ") == "no"
    assert seeded.literal("{'a': None}") == '{"a":null}' and seeded.literal("x y") is None and seeded.literal(None) is None
    assert benchmarks.first_session_rule({}, {"first_session_rule": "direct"}) == "direct" and benchmarks.first_session_rule() == "gate_zero_state"
    with pytest.raises(ValueError):
        benchmarks.first_session_rule({"first_session_rule": "direct"}, {"first_session_rule": "gate_zero_state"})
    assert benchmarks.runtime_contract({"max_context_tokens": 10}, 10, 10, 5, 79) == []
    assert benchmarks.runtime_contract({}, 10, 10, 5, 8) == ["no_corpus_limit", "context_limit", "teacher_context_limit", "teacher_sequence"]
    tail = benchmarks.tail_config({"a": "x", "b": "y"}, {"x": 30, "y": 10}, ["b"])
    assert tail["target_tokens"] == 10 and tail["shares"] == {"y": 1.0}


def test_seeded_columns(spark):
    from sessionloom.functions import seeded

    df = spark.createDataFrame([("i1", 5, '{"b":1,"a":2}'), (None, None, None)], "i string, n int, j string")
    got = df.select(seeded.option_order(F.col("i"), F.col("n")).alias("o"), seeded.canonical_arguments(F.col("j")).alias("a"), seeded.canonical_json_col(F.col("j")).alias("c")).collect()
    assert list(got[0].o) == seeded.order_of("i1", 5) and got[0].a == '{"a":2,"b":1}'
    assert got[1].o is None and got[1].a == "{}" and got[1].c is None


def test_operators_on_tables_without_rows(spark):
    empty = spark.createDataFrame([], "session_id string, source string, domain string, events_json string, session_index long")
    s = canonical.sessions_with_events(empty)
    assert segment.segment_sessions(s, 10).count() == 0
    assert indexing.ordered_digest(spark.createDataFrame([], "k int, h string"), ["k"], "h").first()["digest"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    rows = spark.createDataFrame([], "i long, d string, t long, h string, s long, w int")
    assert budget.accept(rows, {"a": 5}, "i", "d", "t", "h", "s", "w").count() == 0


def test_proper_names(spark):
    from sessionloom.functions import names

    catalog = spark.createDataFrame([("harbor_chat", "conversation")], "source string, domain string")
    rows = spark.createDataFrame([("\tHarbor Chat ", None, "English"), ("HARBOR-CHAT", "x", "de-XX"), ("other", "tool", " "), (None, None, None)], "source string, domain string, l string")
    got = names.proper_names(rows, catalog).select("source", "domain", names.language_code(F.col("l")).alias("l")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("harbor_chat", "conversation", "en"), ("harbor_chat", "conversation", "de"), ("other", "tool", "und"), (None, None, "und")], key=str)


def test_windowed_stream(spark, tmp_path):
    from sessionloom.streaming.memory import user_rates

    rows = [("2024-01-01 00:0%d:00" % i, "a", 1.0) for i in range(4)] + [("2024-01-01 00:15:00", "b", 2.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts string, event_type string, value double").json(str(tmp_path / "in"))
    q = user_rates(stream).writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_type, r.n, r.total) for r in spark.table("rates").collect()} == {("a", 4, 4.0), ("b", 1, 2.0)}
