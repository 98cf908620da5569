"""Operators do the whole job: early limits lose nothing."""

from sessionloom.operators import probes
from sessionloom.queries import core

EVENTS = "session_id string, event_id string, event_index int, role string, event_type string, content string, tool_name string, arguments_json string"
KNOWN = "session_id string, probe_id string, prompt string, reference string"


def test_fallback_goes_on_behind_events_without_a_reference(spark):
    told = {"s": [None, "a", "b", " ", "c", "d", "e"], "t": ["x", None, "y"]}
    rows = [(s, f"e{i}", i, "environment", "observation", c, None, None) for s, own in told.items() for i, c in enumerate(own)]
    got = sorted((r.session_id, r["rank"], r.prompt, r.reference) for r in probes.fallback(spark.createDataFrame(rows, EVENTS), spark.createDataFrame([], KNOWN), 5).collect())
    want = []
    for s, own in told.items():
        asked = [(t.replace("{step}", str(n)), c) for t in probes.TEMPLATES for n, c in enumerate(own, 1) if c and c.strip()]
        want += [(s, k, *a) for k, a in enumerate(asked[:5], 1)]
    assert got == sorted(want)


def test_seeds_and_fallbacks_mind_existing_probes(spark):
    rows = [
        ("s", "a", 0, "user", "message", " Straße? ", None, None), ("s", "b", 1, "assistant", "message", "Yes", None, None), ("s", "c", 2, "assistant", "tool_call", "", "find", "{}"),
        ("s", "d", 3, "tool", "tool_result", "found " + "x" * 600, None, None), ("s", "e", 4, "user", "message", "And?", None, None), ("s", "f", 5, "assistant", "message", " ", None, None),
        ("t", "a", 0, "user", "message", "q", None, None), ("t", "b", 1, "assistant", "message", "r", None, None), ("u", "a", 0, "assistant", "tool_call", None, "go", None),
    ]
    have = spark.createDataFrame([("s", "s_p0", "other", "x"), ("s", "s_p2", "STRASSE?", "YES"), ("t", "p", "1", "2"), ("t", "p1", "3", "4"), ("t", "p2", "5", "6")], KNOWN)
    df = spark.createDataFrame(rows, EVENTS)
    got = [tuple(r) for r in probes.seed(df, have, 3).collect()]
    assert got == [("s", "s_p1", "What result did the find tool return at step 4?", "source_tool_result", ("found " + "x" * 600)[:512], ["c", "d"], 1)]
    more = {(r.session_id, r.probe_id): (r.prompt, r.reference, r.evidence_event_ids) for r in probes.fallback(df, have, 3).collect()}
    assert more[("s", "g_p0")] == ("What information was recorded at session step 1?", "Straße?", ["a"])
    assert more[("u", "g_p0")] == ("What information was recorded at session step 1?", "Called go.", ["a"]) and ("t", "g_p0") not in more
    assert probes.seed(df.limit(0), have, 3).count() == 0


def test_bands_of_ids_whose_product_exceeds_64_bits(spark, tmp_path):
    ids = [0, 1, 3221, 3222, 9999, 99_999, -1, -3222, 10**15, 2**63 - 1, -(2**63), None]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    df = core.QUERIES["scl5_bands"](spark, str(tmp_path))
    assert [t for _, t in df.dtypes] == ["bigint"] * 3
    got = {(r.doc_id, r.band): r.value for r in df.collect()}
    assert got == {(i, b): None if i is None else (i * 2862933555777941 + 3037000493 >> 16 * b) & 65535 for i in ids for b in range(4)}
