"""Small cases of the operators whose rules are easily got wrong."""

import json

import pytest
from pyspark.sql import functions as F

from leafmill.functions import parsers as P
from leafmill.functions import structures as S
from leafmill.functions import text as X
from leafmill.operators import aggregates as A
from leafmill.operators import joins as J
from leafmill.operators import validation as V
from leafmill.operators import windows as W
from leafmill.sources import logs as L
from leafmill.streaming import tails


def test_turn_segments_follow_the_markers(spark):
    rows = [("s", i, k) for i, k in enumerate("xSxCxSAxSx")]
    df = spark.createDataFrame(rows, "session string, pos int, k string")
    out = W.turn_segments(df, ["session"], "pos", F.col("k") == "S", F.col("k").isin("C", "A"))
    got = {r.pos: (r.segment, r.closed) for r in out.collect()}
    assert [p for p in got if got[p][0] == 0] and {p for p in got if got[p][0] == 0} == {0, 4, 7}
    assert [got[p] for p in (1, 2, 3)] == [(1, True)] * 3
    assert [got[p] for p in (5, 6)] == [(2, True)] * 2
    assert [got[p] for p in (8, 9)] == [(3, False)] * 2


def test_similar_calls_see_eight_before_and_the_row(spark):
    df = spark.createDataFrame([(1, i, "a") for i in range(12)], "k int, o int, s string")
    assert [r.similar for r in W.similar_in_frame(df, ["k"], ["o"], "s").orderBy("o").collect()] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 9]


def test_thinning_depends_on_kept_rows(spark):
    df = spark.createDataFrame([(1, t) for t in (0.0, 0.3, 0.6, 0.9, 1.1, 1.7)], "k int, t double")
    assert [r.t for r in W.thinned(df, "k", "t", 0.5).orderBy("t").collect()] == [0.0, 0.6, 1.1, 1.7]


def test_token_windows_stop_at_the_end(spark):
    df = spark.createDataFrame([(1, list("abcdefghij")), (2, ["x"]), (3, [])], "k int, t array<string>")
    got = [(r.k, r.ord, r.start, r.n_tokens) for r in W.token_windows(df, "k", F.col("t"), 4, 1).orderBy("k", "ord").collect()]
    assert got == [(1, 0, 0, 4), (1, 1, 3, 4), (1, 2, 6, 4), (2, 0, 0, 1)]


def test_torn_tail_is_left_out_and_damage_fails(spark, tmp_path):
    good = "\n".join(json.dumps({"id": str(i), "ts": "t", "type": "message", "parent_id": None, "role": "user", "text": f"m{i}"}) for i in range(4))
    (tmp_path / "a.jsonl").write_text(good + '\n{"incomplete":')
    rows = L.parsed(L.complete_lines(spark, str(tmp_path)), "message").orderBy("line_no").collect()
    assert [r.text for r in rows] == ["m0", "m1", "m2", "m3"]
    (tmp_path / "b.jsonl").write_text('{"id": "1"\n' + good + "\n")
    with pytest.raises(Exception):
        L.parsed(L.complete_lines(spark, str(tmp_path)), "message").collect()


def test_manifest_with_a_broken_row_is_ignored(spark):
    lines = [("a", 0, '{"record_type": "header"}'), ("a", 1, '{"record_type": "paper"}'), ("b", 0, '{"record_type": "header"}'), ("b", 1, "{oops")]
    header, papers = L.manifest(spark.createDataFrame(lines, "path string, line_no int, line string"))
    assert [r.path for r in header.collect()] == ["a"] and [r.path for r in papers.collect()] == ["a"]


def test_inventory_and_snapshots(spark, tmp_path):
    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "x" / "A.PDF").write_bytes(b"one")
    (tmp_path / "in" / "b.txt").write_bytes(b"two")
    rows = L.inventory(spark, str(tmp_path / "in")).collect()
    assert len(rows) == 1 and rows[0]["size"] == 3 and len(rows[0].short_id) == 12
    L.snapshot(spark.range(3).toDF("n"), str(tmp_path / "t"), "v1")
    L.snapshot(spark.range(5).toDF("n"), str(tmp_path / "t"), "v2")
    assert L.current(spark, str(tmp_path / "t")).count() == 5


def test_event_streams_and_synthetic_events(spark):
    lines = spark.createDataFrame([(": hi",), ('data: {"a": 1}',), ("data: [DONE]",), ("event: x",)], "line string")
    assert L.sse(lines).count() == 1
    e = L.synthetic_events(spark, 5, 7)
    assert e.count() == 30 and W.sequence_gaps(e.withColumn("k", F.lit(1)), ["k"], "seq").count() == 0


def test_merge_patches():
    assert S.merge_patch({"a": 1}, {"a": 1}) is None
    assert S.merge_patch({"a": 1, "b": {"c": 1, "d": 2}}, {"b": {"c": 3}}) == {"a": None, "b": {"c": 3, "d": None}}
    for target, patch, out in (
        ({"a": "b"}, {"a": "c"}, {"a": "c"}), ({"a": "b"}, {"b": "c"}, {"a": "b", "b": "c"}), ({"a": "b"}, {"a": None}, {}), ({"a": ["b"]}, {"a": "c"}, {"a": "c"}),
        ({"a": {"b": "c"}}, {"a": {"b": "d", "c": None}}, {"a": {"b": "d"}}), (["a"], {"a": "b"}, {"a": "b"}), ({"e": None}, {"a": 1}, {"e": None, "a": 1}), ({}, {"a": {"bb": {"ccc": None}}}, {"a": {"bb": {}}}),
    ):
        assert S.apply_patch(target, patch) == out
    assert S.without_nulls({"a": None, "b": [None, {"c": None}]}) == {"b": [None, {}]}


def test_state_needs_a_full_row_first(spark):
    rows = [("a", 1, "patch", '{"x": 1}'), ("a", 2, "full", '{"y": 1}'), ("a", 3, "patch", '{"x": 2, "y": null}'), ("b", 1, "patch", '{"x": 1}')]
    df = spark.createDataFrame(rows, "k string, o int, mode string, state string")
    assert [(r.k, r.state) for r in S.folded_state(df, "k", "o", "mode", "state").collect()] == [("a", '{"x":2}')]


def test_references_are_inlined():
    schema = {"$defs": {"a": {"type": "string", "title": "x"}}, "properties": {"p": {"$ref": "#/$defs/a", "title": "y"}}}
    assert S.inlined_refs(schema) == {"properties": {"p": {"type": "string", "title": "y"}}}
    with pytest.raises(ValueError):
        S.inlined_refs({"$defs": {"a": {"$ref": "#/$defs/a"}}, "$ref": "#/$defs/a"})


def test_sanitized_payloads():
    out = S.sanitized({"X-Api-Key": "k", "text": "a" * 3000, "many": list(range(60)), "wide": {str(i): i for i in range(120)}})
    assert out["X-Api-Key"] == S.REDACTED and out["text"]["length"] == 3000 and out["many"][-1] == {"_trace_value": "truncated_items", "omitted": 10} and out["wide"]["_trace_omitted_keys"] == 20
    assert S.sanitized({"Set-Cookie": "a", "Proxy-Authorization": "b", "note": "Bearer abcdefgh and token password=x"}) == {"Set-Cookie": S.REDACTED, "Proxy-Authorization": S.REDACTED, "note": "Bearer [REDACTED] and token password=[REDACTED]"}
    long = S.sanitized("password=" + "x" * 3000)
    assert long == "password=[REDACTED]"  # redacted before it is cut
    deep = 1
    for _ in range(9):
        deep = [deep]
    assert S.canonical(S.sanitized(deep)).count("[") == 8 and "max_depth" in S.canonical(S.sanitized(deep))
    whole = S.bounded_payload({str(i): {str(j): "y" * 1900 for j in range(20)} for i in range(10)})
    assert whole["_trace_value"] == "truncated_payload" and len(whole["preview"]) == 16_384 and whole["sanitized_bytes"] > 262_144


def test_strict_fields_do_not_cast(spark):
    df = spark.createDataFrame([('{"n": 5}',), ('{"n": "5"}',), ('{"n": true}',), ("{}",), ("oops",), (None,)], "j string")
    assert [r.n for r in df.select(S.strict_field(F.col("j"), "$.n", "bigint", -1).alias("n")).collect()] == [5, -1, -1, -1, -1, -1]


def test_character_maps(spark):
    text = "beginbfchar\n<01> <0041>\n<02> <0042>\nendbfchar\nbeginbfrange\n<10> <12> <0061>\nendbfrange"
    clash = "beginbfchar\n<01> <0041>\n<01> <0042>\nendbfchar"
    df = spark.createDataFrame([(1, text), (2, clash)], "id int, t string")
    assert sorted((r.id, r.code, r.unicode) for r in S.expanded_cmap(df, "id", "t").collect()) == [(1, 1, 65), (1, 2, 66), (1, 16, 97), (1, 17, 98), (1, 18, 99)]


def test_parsers():
    assert P.shell_parts("a 'x; y' && b | c; (d; e)\nf \\; g") == ["a 'x; y'", "b", "c", "(d; e)", "f \\; g"]
    assert P.read_command('paper search x.pdf "two words"') == ("search", ["x.pdf", "two words"])
    assert P.read_command("paper read 'x") is None and P.read_command("ls") is None
    blocks = P.markdown_blocks("# T\n\nline one\nline two\n\n- item\n  more\n> q\n```\ncode\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n---")
    assert [b[0] for b in blocks] == ["heading", "paragraph", "item", "quote", "fence", "table", "rule"] and blocks[1][2] == "line one line two"
    assert P.inline_math(r"cost \$5 and $x^2$ or `$y$`") == [("text", r"cost \$5 and "), ("math", "x^2"), ("text", " or `$y$`")]
    assert P.unified("a\nb", "a\nc").splitlines()[-2:] == ["-b", "+c"]


def test_text_functions(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert row(X.arxiv_id(F.lit("arXiv:1917.51862v3"))) == "1917.51862" and row(X.arxiv_id(F.lit("nope"))) is None
    assert row(X.redacted(F.lit("Bearer abc password: x1, sk-123456789"))) == "Bearer [REDACTED] password: [REDACTED], [REDACTED]"
    assert row(X.search_key(F.lit("Straße  Ⅸ"))) == "strasse ix"
    assert row(X.head_and_tail(F.lit("é" * 40), 5)).startswith("é" * 5) and "�" not in row(X.head_and_tail(F.lit("aé" * 40), 5))
    assert row(X.visible_controls(F.lit("a\x00\n\x7f"))) == "a␀\n␡"
    assert row(X.bare_latex(F.lit("$$x$$"))) == "x" and row(X.bare_latex(F.lit(r"\(x\)"))) == "x" and row(X.bare_latex(F.lit("$x$"))) == "x"
    assert row(X.lines(F.lit("a\r\nb\x0bc\n"))) == ["a", "b", "c"]
    assert row(X.garble_count(F.lit("a�\x01\tb"))) == 2
    assert row(X.used_fraction(F.lit(12_000), F.lit(272_000))) == 0.0
    assert row(X.iso_instant(F.lit("2031-01-01T00:00:00"))) is None and row(X.iso_instant(F.lit("2031-01-01T00:00:00Z"))) is not None
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000001000000002008060000")
    df = spark.createDataFrame([(bytearray(png),), (bytearray(b"no"),)], "b binary").select(X.png_size(F.col("b")).alias("s")).collect()
    assert (df[0].s.width, df[0].s.height) == (256, 32) and df[1].s is None


def test_validation(spark):
    df = spark.createDataFrame([(1, "a"), (-1, None)], "n int, s string")
    rows = V.violations(df, {"n": F.col("n") > 0, "s": F.col("s") != ""}).orderBy("n").collect()
    assert [r.violations for r in rows] == [["n", "s"], []]
    assert spark.range(1).select(V.summary(F.array(*[F.lit(str(i)) for i in range(7)])).alias("x")).first().x == "0; 1; 2; 3; 4; ... 2 more"
    with pytest.raises(Exception):
        V.checked(df, F.col("n") > 0, "bad").collect()
    wanted = spark.createDataFrame([("a", "f1"), ("b", "f1"), ("c", "f1"), ("d", "f2")], "k string, fp string")
    manifests = spark.createDataFrame([("a", "f1", "h"), ("b", "f1", "h"), ("d", "f1", "h")], "k string, fp string, sha256 string")
    files = spark.createDataFrame([("a", "h"), ("b", "x"), ("d", "h")], "k string, sha256 string")
    assert {r.k: r.state for r in V.cache_state(wanted, manifests, files, "k", "fp").collect()} == {"a": "hit", "b": "corrupt", "c": "miss", "d": "incompatible"}


def test_trace_faults(spark):
    rows = [("t", 1, "e1", "root", None, "s"), ("t", 2, "e2", "kid", "root", "s"), ("t", 3, "e3", "kid", "root", "e"), ("t", 4, "e4", "root", None, "e"), ("u", 2, "f1", "root", None, "s"), ("u", 2, "f1", "lost", "gone", "s")]
    df = spark.createDataFrame(rows, "trace string, seq int, id string, entity string, parent string, phase string")
    got = {r.trace: r for r in V.trace_faults(df, ["trace"], "seq", "id", "entity", "parent", F.col("phase") == "s", F.col("phase") == "e").collect()}
    assert (got["t"].gaps, got["t"].roots, got["t"].unknown_parents, got["t"].several_ends) == (0, 1, 0, 0)
    assert got["u"].gaps >= 1 and got["u"].repeated_ids == 2 and got["u"].unknown_parents == 1


def test_closure_ends_on_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "s string, t string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.steps) for r in J.closure(spark, links, "s", "t", start).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_paths_overlap(spark):
    a = spark.createDataFrame([("/x",), ("/x/y",), ("/xy",)], "a string")
    b = spark.createDataFrame([("/x/y/z",), ("/x",)], "b string")
    assert {(r.a, r.b) for r in J.overlapping_paths(a, b, "a", "b").collect()} == {("/x", "/x/y/z"), ("/x", "/x"), ("/x/y", "/x/y/z"), ("/x/y", "/x")}


def test_prefix_rules_keep_their_order(spark):
    df = spark.createDataFrame([("abc",), ("ab",), ("z",)], "m string")
    rules = spark.createDataFrame([("ab", 1, "first"), ("abc", 2, "second")], "prefix string, rank int, name string")
    assert {r.m: (r.rule.name if r.rule else None) for r in J.by_prefix(df, "m", rules).collect()} == {"abc": "first", "ab": "first", "z": None}


def test_recall_leaves_out_queries_without_relevant_items(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "a", 1)], "q string, i string, rank int")
    relevant = spark.createDataFrame([("q", "a"), ("q", "c")], "q string, i string")
    assert [(r.q, r.recall) for r in A.recall_at(ranked, relevant, "q", "i", 1).collect()] == [("q", 0.5)]


def test_stream_keeps_each_event_once(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 10).alias("event_id"), F.lit("2031-01-01").cast("timestamp").alias("at"), (F.col("id") % 2).alias("k"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = tails.tail(spark, str(tmp_path / "in"), rows.schema)
    assert tails.drained(tails.once(stream, ["event_id"], "at"), "once_rows", str(tmp_path / "c1")).count() == 10
    got = tails.drained(tails.advancing(stream, "k", "event_id"), "advanced_rows", str(tmp_path / "c2"))
    assert sorted((r.k, r.event_id) for r in got.collect()) == sorted((i % 2, i) for i in range(10))


def test_cursor_takes_chunks_in_any_order(spark, tmp_path):
    """Small Arrow chunks of one trigger, and rows of a second trigger behind and before the cursor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        one = spark.createDataFrame([(0, n) for n in (1, 5, 9, 2, 3, 10, 5)], "k bigint, event_id bigint").coalesce(1)
        one.write.parquet(str(tmp_path / "in"))
        rows = lambda: sorted(r.event_id for r in tails.drained(tails.advancing(tails.tail(spark, str(tmp_path / "in"), one.schema), "k", "event_id"), "cursor", str(tmp_path / "out")).collect())
        assert rows() == [1, 2, 3, 5, 9, 10]
        spark.createDataFrame([(0, 4), (0, 11)], "k bigint, event_id bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert rows() == [1, 2, 3, 5, 9, 10, 11]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_chains_are_followed_to_their_end(spark):
    links = spark.range(40).select(F.col("id").alias("s"), (F.col("id") + 1).alias("t"))
    assert J.closure(spark, links, "s", "t", spark.range(1).toDF("node")).agg(F.max("steps")).first()[0] == 40


def test_inherited_sessions(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("e", "a"), ("e", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("f", "d")]
    out = J.inherited(spark, spark.createDataFrame(rows, "session string, base string"), "session", "base").collect()
    assert {(r.source, r.depth) for r in out if r.session == "c"} == {("c", 0), ("b", 1), ("a", 2)}
    error = {r.session: r.error for r in out}
    assert error == {"a": None, "b": None, "c": None, "d": "unavailable", "e": "several bases", "x": "cycle", "y": "cycle", "z": "cycle", "f": "unavailable"}


def test_flushes(spark):
    rows = [("j", 1, 50, True, 0), ("j", 2, 50, True, 10), ("j", 3, 5, True, 20), ("j", 4, 0, False, 30), ("j", 5, 5, True, 40), ("j", 6, 5, True, 200), ("j", 7, 5, True, 210)]
    df = spark.createDataFrame(rows, "job string, seq int, n int, delta boolean, at bigint")
    got = tails.flush_groups(df, ["job"], "seq", F.col("n"), F.col("delta"), F.col("at")).orderBy("seq").collect()
    assert [r.flush for r in got] == [0, 0, 1, 1, 2, 2, 3]


def test_set_faults(spark):
    h = "a" * 64
    rows = [("ok", [h], [], None, None), ("twice", [h, h], [], None, None), ("odd", [], ["x"], [h], "r"), ("own", [h], ["b" * 64], None, None), ("part", [h], [], [h, "b" * 64], None), ("why", [h], ["b" * 64], [h, "b" * 64], None), ("fine", [h], ["b" * 64], [h, "b" * 64], "r")]
    df = spark.createDataFrame(rows, "k string, members array<string>, excluded array<string>, parent array<string>, reason string")
    assert {r.k: r.fault for r in V.set_faults(df, ["k"]).collect()} == {"ok": None, "twice": "members repeat", "odd": "invalid exclusion", "own": "exclusions without a parent", "part": "no partition of the parent", "why": "exclusions without a reason", "fine": None}


def test_set_states(spark):
    rows = [("l", "a", 1, "created", None), ("l", "b", 2, "derived", "a"), ("l", "b", 3, "evidence_recorded", None), ("l", "b", 4, "completed", None), ("l", "c", 5, "derived", "d"), ("l", "d", 6, "created", None), ("l", "d", 7, "completed", None), ("l", "e", 8, "evidence_recorded", None), ("l", "f", 9, "created", "a")]
    df = spark.createDataFrame(rows, "log string, id string, seq int, name string, parent string")
    got = {r.id: (r.completed, r.error) for r in tails.set_states(df, ["log", "id"], "seq").collect()}
    assert got == {"a": (False, None), "b": (True, None), "c": (False, "unknown parent"), "d": (True, "completed before evidence"), "e": (False, "unknown set"), "f": (False, "created with a parent")}


def test_broken_bytes_become_readable(spark):
    df = spark.createDataFrame([(bytearray(b"a\xed\xa0\x80b"),), (None,)], "b binary")
    first, none = (r.t for r in df.select(X.without_surrogates(F.col("b")).alias("t")).collect())
    assert first[0] == "a" and first[-1] == "b" and set(first[1:-1]) == {"\ufffd"} and none is None


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, o int, s string, n bigint")
    assert W.run_length(df, ["k"], ["o"], "s").count() == 0
    assert W.recent_suffix(df, ["k"], "o", "n", 5).count() == 0
    assert A.duplicates(df, ["k"]).count() == 0
    assert W.thinned(df, "k", "o", 1).count() == 0


def test_running_sums_of_a_large_key(spark):
    rows = [("hot", i, i % 7) for i in range(3000)] + [("cold", 1, 5), (None, 1, 2), (None, 2, 3)]
    df = spark.createDataFrame(rows, "k string, o int, v bigint").repartition(5)
    got = {(r.k, r.o): r.before for r in W.running_before(df, ["k"], ["o"], F.col("v"), "before").collect()}
    assert len(got) == len(rows) and got["cold", 1] == 0 and got[None, 2] == 2
    assert all(got["hot", i] == sum(j % 7 for j in range(i)) for i in (0, 1, 500, 1499, 2999))


def test_numbers_over_everything(spark):
    df = spark.range(2000).select((F.col("id") * 7 % 2003).alias("id")).repartition(6)
    got = [r.n for r in A.global_numbers(df, "id", descending=True).orderBy(F.desc("id")).collect()]
    assert got == list(range(1, 2001))


def test_lines_of_files_in_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        for name, end in (("whole", "\n"), ("torn", "")):
            (tmp_path / f"{name}.jsonl").write_text("\n".join(f'{{"n": {i}, "t": "é"}}' for i in range(50)) + end)
        (tmp_path / "only.jsonl").write_text("never finished")
        (tmp_path / "empty.jsonl").write_text("")
        got = {}
        for r in L.complete_lines(spark, str(tmp_path)).collect():
            got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.line_no, json.loads(r.line)["n"]))
        assert sorted(got["whole.jsonl"]) == [(i, i) for i in range(50)] and sorted(got["torn.jsonl"]) == [(i, i) for i in range(49)] and set(got) == {"whole.jsonl", "torn.jsonl"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tombstones_check_what_they_replace(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":2}'), (3, '{"a":3}'), (4, '{"a":4}')], "id int, payload string")
    sha = lambda c: F.sha2(c, 256)
    scan = df.filter("id < 4").select("id", F.when(F.col("id") == 2, "x").otherwise(sha("payload")).alias("original_file_sha256"), F.when(F.col("id") == 3, "x").otherwise(sha("payload")).alias("original_value_sha256"))
    out = {r.id: r for r in V.removed(df, scan, ["id"], "payload", F.lit("2031-01-01T00:00:00Z").cast("timestamp")).collect()}
    stone = json.loads(out[1].payload)
    assert stone["reason"] == "retention" and stone["original_bytes"] == 7 and stone["removed_at"] == "2031-01-01T00:00:00Z" and out[1].released == 0 and out[1].fault is None
    assert (out[2].fault, out[3].fault, out[4].fault) == ("changed", "changed", None) and out[2].payload == '{"a":2}'
    again = V.removed(spark.createDataFrame([(1, out[1].payload)], "id int, payload string"), scan, ["id"], "payload", F.current_timestamp()).first()
    assert again.fault == "removed" and again.payload == out[1].payload
