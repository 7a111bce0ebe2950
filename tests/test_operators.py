"""Single operators with known values, and graph loops against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphmill.functions import logs, scores, strings
from graphmill.operators import architecture, graph, impact, incremental, linking, retrieval, telemetry
from graphmill.sources import readers
from graphmill.streaming import spans


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize(("x", "want"), [(0, 0.0), (10, 0.25), (20, 0.5), (50, 0.85), (200, 1.0)])
def test_complexity(spark, x, want):
    assert one(spark, scores.normalized_complexity(F.col("x")), x=x) == pytest.approx(want)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("getUserById", "METHOD_NAME"), ("UserService", "CLASS_NAME"), ("com.acme.app.UserService.load", "FULL_QUALIFIED_NAME"), ("com.acme.app.UserService", "FULL_QUALIFIED_CLASS_NAME"),
        ("app.api.users.get_user", "FULL_QUALIFIED_NAME"), ("SELECT * FROM t", "SQL_SNIPPET"), ("GET /api/x", "HTTP_URI"), ("/api/x", "HTTP_URI"), ("return foo(a);", "CODE_SNIPPET"),
        ("@RestController", "ANNOTATION"), ("NullPointerException", "EXCEPTION_TYPE"), ("用户登录", "NATURAL_LANGUAGE"), ("how does it work", "NATURAL_LANGUAGE"), ("", "NATURAL_LANGUAGE"), (None, "NATURAL_LANGUAGE"), ("UserService.load", "METHOD_NAME"),
    ],
)
def test_query_type(spark, text, want):
    df = spark.createDataFrame([(text,)], "q string")
    assert df.select(strings.query_type(F.col("q"))).first()[0] == want


def test_urls(spark):
    df = spark.createDataFrame([("/Users/{id}/",), ("/a/:b/<int:c>",), ("/",), (None,)], "u string")
    assert [r[0] for r in df.select(strings.normalize_url(F.col("u"))).collect()] == ["/users/{}", "/a/{}/{}", "/", ""]
    df = spark.createDataFrame([("/api/users/${id}",), ("users",), ("/api",), (None,)], "u string")
    assert [r[0] for r in df.select(strings.normalize_frontend_url(F.col("u"))).collect()] == ["/users/:param", "/users", "/", ""]
    assert one(spark, strings.normalize_entry_key(F.col("k")), k="get /Users/{id}") == "GET /users/{}"
    assert one(spark, strings.normalize_route(F.col("k")), k="/api/users/123?x=1") == "/api/users/{id}"
    assert one(spark, strings.strip_proxy(F.col("k")), k="a.B$$EnhancerBySpringCGLIB$$12") == "a.B"


def test_logs(spark):
    text = "x\njava.lang.IllegalStateException: no\n\tat org.apache.a.B.c(B.java:1)\n\tat my.Own.run(Own.java:2)\nCaused by: my.BadError: y"
    assert one(spark, logs.error_type(F.col("t")), t=text) == "java.lang.IllegalStateException"
    assert one(spark, logs.own_frames(F.col("t")), t=text) == ["my.Own.run"]
    assert one(spark, logs.last_cause(F.col("t")), t=text) == "my.BadError"
    assert one(spark, logs.fingerprint(F.col("t")), t="") == "0" * 32
    a, b = one(spark, logs.fingerprint(F.col("t")), t="plain a"), one(spark, logs.fingerprint(F.col("t")), t="plain b")
    assert a != b
    line = one(spark, logs.parsed_line(F.col("t")), t="2024-01-02 03:04:05.678 [main] ERROR a.b.C [t1] - boom")
    assert tuple(line) == ("2024-01-02 03:04:05.678", "main", "ERROR", "a.b.C", "t1", "boom")


def reach_plain(edges, seed, depth=None):
    seen, now, d = {seed: 0}, [seed], 0
    while now and (depth is None or d < depth):
        d += 1
        now = sorted({b for a, b in edges if a in now and b not in seen})
        seen |= {x: d for x in now}
    return seen


def test_reach_and_scc(spark):
    rng = random.Random(4)
    for n, m in ((8, 12), (15, 20)):
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
        df = spark.createDataFrame(edges, "src long, dst long")
        got = {r["node"]: r["depth"] for r in graph.reach_once(df, spark.createDataFrame([(edges[0][0],)], "seed long"), 3).collect()}
        assert got == reach_plain(edges, edges[0][0], 3)
        full = {x: set(reach_plain(edges, x)) for x in range(n)}
        loops = {a for a, b in edges if a == b}
        want = {}
        for x in range(n):
            comp = {y for y in full[x] if x in full[y]}
            if len(comp) > 1 or x in loops:
                want[x] = min(comp)
        assert {r["node"]: r["component"] for r in graph.strongly_connected(df).collect()} == want


def test_communities(spark):
    edges = []
    for c in range(40):
        nodes = [c * 5 + k for k in range(5)]
        edges += [("p", a, b, 1.0) for a in nodes for b in nodes if a < b] + [("p", c * 5, (c * 5 + 5) % 200, 0.1)]
    found = graph.louvain(spark.createDataFrame(edges, "project string, src long, dst long, weight double")).collect()
    assert len(found) == 200 and len({r["community"] for r in found}) <= 20
    dense = [("p", a, b, 1.0) for a in range(10) for b in range(a)]
    assert len({r["community"] for r in graph.louvain(spark.createDataFrame(dense, "project string, src long, dst long, weight double")).collect()}) == 1


def test_roles_and_layers(spark):
    df = spark.createDataFrame([(None, "a.UserController", "a"), (["x.Service"], "a.Foo", "b"), (None, "a.Foo", "b.mapper"), (None, "Foo", None)], "n array<string>, c string, p string")
    assert [r[0] for r in df.select(architecture.class_role(F.col("n"), F.col("c"), F.col("p"))).collect()] == ["CONTROLLER", "SERVICE", "REPOSITORY", "UNKNOWN"]
    modules = spark.createDataFrame([("a", "CONTROLLER"), ("b", "SERVICE"), ("u", "UTILITY"), ("x", "UNKNOWN")], "module string, layer string")
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "u"), ("b", "x")], "src string, dst string")
    assert [tuple(r)[:2] for r in architecture.package_violations(modules, edges).collect()] == [("b", "a")]
    few = modules.withColumn("layer", F.when(F.col("module") == "a", "CONTROLLER").otherwise("UNKNOWN"))
    assert architecture.package_violations(few, edges).count() == 0


def test_links(spark):
    calls = spark.createDataFrame([(1, "p", "get", "/Users/:id"), (2, "q", "get", "/users/{x}")], "id long, project string, method string, url string")
    entries = spark.createDataFrame([(9, "q", "GET /users/{id}/")], "id long, project string, key string")
    assert [tuple(r) for r in linking.http_links(calls, entries).collect()] == [(1, 9, "HTTP")]
    clients = spark.createDataFrame([(1, "get", "/api/users/${id}")], "id long, method string, url string")
    backend = spark.createDataFrame([(5, "GET /api/users/{id}"), (4, "get /users/{x}")], "id long, key string")
    assert [tuple(r) for r in linking.frontend_links(clients, backend).collect()] == [(1, 4)]
    modules = spark.createDataFrame([("a", "g", "a", ["g:b:1", "z:z:1"]), ("b", "g", "b", [])], "module string, group_id string, artifact_id string, dependencies array<string>")
    assert [tuple(r) for r in linking.artifact_edges(modules).collect()] == [("a", "b")]


def test_fusion(spark):
    lists = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 8.0), ("b", 2, 1.0)], "list string, id long, raw double")
    assert {r["id"]: r["score"] for r in retrieval.fuse(lists).collect()} == {1: round(1 / 61, 6), 2: round(1 / 62 + 1 / 61, 6)}


def test_incremental(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, hash string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "id long, hash string")
    assert {tuple(r) for r in incremental.hash_split(old, new).collect()} == {(1, "DELETE"), (2, "OVERWRITE"), (3, "REUSE"), (4, "INSERT")}
    ext = spark.createDataFrame([("C", "B"), ("B", "A")], "child string, parent string")
    own = spark.createDataFrame([("A", "f"), ("A", "g"), ("B", "g"), ("C", "h")], "owner string, method string")
    assert {tuple(r) for r in incremental.inherited_methods(ext, own).collect()} == {("B", "f", "A"), ("C", "f", "A"), ("C", "g", "B")}


def payload(spans_of):
    attr = lambda k, v: {"key": k, "value": {"stringValue": v}}
    return {"resourceSpans": [{"resource": {"attributes": [attr("service.name", "svc")]}, "scopeSpans": [{"scope": {"name": "s", "version": "1"}, "spans": [
        {"traceId": "t", "spanId": str(k), "parentSpanId": "" if not k else str(k - 1), "name": f"op{k}", "kind": 2, "startTimeUnixNano": "1000000", "endTimeUnixNano": "bad" if k == 2 else "5000000", "status": {"code": 0, "message": ""}, "attributes": [], "events": [{"name": "exception", "timeUnixNano": "1", "attributes": [attr("exception.type", e)]}] if e else []}
        for k, e in enumerate(spans_of)]}]}]}


def test_span_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(payload([None, "X", None])))
    sessions = spark.createDataFrame([("svc", "s1")], "service string, session_id string")
    out = spans.ingest(spans.read_payloads(spark, str(tmp_path / "in")), sessions)
    q = out.writeStream.format("memory").queryName("spans_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = {r["span_id"]: r for r in spark.sql("select * from spans_out").collect()}
    assert len(rows) == 3 and rows["1"]["silent_catch"] and not rows["0"]["silent_catch"]
    assert rows["0"]["duration_ms"] == 4 and rows["2"]["duration_ms"] == 0 and rows["0"]["kind"] == "SERVER" and rows["0"]["parent_span_id"] is None
    tree = graph.span_tree(spark.table("spans_out")).collect()
    assert {r["span_id"]: r["depth"] for r in tree} == {"0": 0, "1": 1, "2": 2}


def test_stateful_streams(spark, tmp_path):
    src = tmp_path / "lines"
    spark.createDataFrame([("a.BadError: x",), ("a.BadError: y",), ("other",)], "text string").coalesce(1).write.json(str(src))
    q = spans.count_fingerprints(spark.readStream.schema("text string").json(str(src))).writeStream.outputMode("update").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert sorted(r["occurrences"] for r in spark.table("counts").collect()) == [1, 2]
    changes = tmp_path / "changes"
    spark.createDataFrame([("r", 1, "RUNNING"), ("r", 2, "PENDING"), ("r", 3, "DONE")], "report_id string, seq long, state string").coalesce(1).write.json(str(changes))
    q = spans.follow_reports(spark.readStream.schema("report_id string, seq long, state string").json(str(changes))).writeStream.outputMode("update").format("memory").queryName("reports").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("reports").collect()] == [("r", "DONE", 1)]


def test_append_once(spark, tmp_path):
    write = spans.append_once(str(tmp_path / "log"), "key", "session", ["key"])
    batch = spark.createDataFrame([("a", "s"), ("b", "s"), ("b", "s")], "key string, session string")
    write(batch, 0)
    write(batch.union(spark.createDataFrame([("c", "s")], "key string, session string")), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).select("key", "seq").collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_log_search(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "ERROR", "disk full", "t"), ("2024-01-02 00:00:00", "INFO", "disk ok", "t")], "a string, level string, message string, trace_id string").withColumn("at", F.to_timestamp("a"))
    assert [r["message"] for r in telemetry.search_logs(df, levels=["ERROR"], wildcard="disk*").collect()] == ["disk full"]


def test_readers(spark, tmp_path):
    (tmp_path / "pom.xml").write_text('<project xmlns="http://m"><groupId>g</groupId><artifactId>a</artifactId><version>1</version><properties><v.x>2</v.x></properties><dependencies><dependency><groupId>g</groupId><artifactId>b</artifactId><version>${v.x}</version></dependency></dependencies></project>')
    assert [tuple(r)[1:] for r in readers.read_poms(spark, str(tmp_path)).collect()] == [("g", "a", "1", ["g:b:2"])]
    (tmp_path / "m.xml").write_text('<mapper namespace="a.M"><select id="one" resultType="x">select *\n from t <if test="a">where b</if></select></mapper>')
    assert [tuple(r) for r in readers.read_mappers(spark, str(tmp_path)).collect()] == [("a.M", "one", "SELECT", "select * from t where b")]
    (tmp_path / "A.java").write_text('class A {\n @GetMapping("/x")\n void f() { restTemplate.getForObject("/y/{id}"); }\n}')
    (tmp_path / "b.py").write_text('@router.post("/z")\ndef g(): pass\n')
    assert sorted(tuple(r)[1:] for r in readers.scan_sources(spark, str(tmp_path)).collect()) == [("HTTP", "GET", "/x", 2), ("HTTP", "POST", "/z", 1), ("HTTP_CALL", "GET", "/y/{id}", 3)]
    (tmp_path / "log.txt").write_text("@c1|me|2024-01-01T00:00:00Z\n1\t2\ta.py\n3\t0\tb.py\n@c2|you|2024-01-02T00:00:00Z\n5\t5\ta.py\n")
    assert sorted(tuple(r)[1:] for r in readers.read_commits(spark, str(tmp_path / "log.txt")).select("repo", "commit", "file", "lines").collect()) == [("c1", "a.py", 3), ("c1", "b.py", 3), ("c2", "a.py", 10)]


def test_node_sink(spark, tmp_path):
    a = spark.createDataFrame([(1, "p", "x"), (2, "q", "y")], "id long, project string, v string")
    readers.write_nodes(a, str(tmp_path / "n"))
    readers.write_nodes(spark.createDataFrame([(1, "p", "z"), (3, "p", "w")], "id long, project string, v string"), str(tmp_path / "n"))
    assert sorted(tuple(r) for r in readers.label_scan(spark, str(tmp_path / "n")).select("id", "project", "v").collect()) == [(1, "p", "z"), (2, "q", "y"), (3, "p", "w")]


def test_commits_of_a_very_large_import(spark, tmp_path):
    from graphmill.sources import readers

    log = ["@aaa|a@x|2024-01-02T00:00:00+00:00", ""] + [f"{k}\t1\tdir/f{k}.java" for k in range(20_000)] + ["-\t-\tlogo.png", "", "@bbb|b@x|2024-01-03T00:00:00+00:00", "", "2\t0\tREADME.md"]
    (tmp_path / "repo.log").write_text("\n".join(log))
    rows = readers.read_commits(spark, str(tmp_path)).groupBy("commit", "author").agg(F.count("*").alias("n"), F.sum("lines").alias("lines")).collect()
    assert {(r["commit"], r["author"], r["n"], r["lines"]) for r in rows} == {("aaa", "a@x", 20_001, sum(range(20_000)) + 20_000), ("bbb", "b@x", 1, 2)}


def test_diffs(spark, tmp_path):
    from graphmill.sources import readers

    diff = "diff --git a/src/A.java b/src/A.java\nindex 1..2 100644\n--- a/src/A.java\n+++ b/src/A.java\n@@ -1,2 +1,3 @@\n-old\n+new\n+more\n same\ndiff --git a/b.png b/b.png\nnew file mode 100644\nBinary files /dev/null and b/b.png differ\ndiff --git a/gone.py b/gone.py\ndeleted file mode 100644\n--- a/gone.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
    (tmp_path / "one.diff").write_text(diff)
    rows = readers.read_diff(spark, str(tmp_path)).select("file", "status", "additions", "deletions").collect()
    assert sorted(map(tuple, rows)) == [("b.png", "ADDED", 0, 0), ("gone.py", "DELETED", 0, 1), ("src/A.java", "MODIFIED", 2, 1)]


def test_repeated_attributes_and_roots(spark):
    from graphmill.operators import telemetry
    from graphmill.streaming import spans

    attr = lambda k, v: {"key": k, "value": {"stringValue": v}}
    span = {"traceId": "t", "spanId": "s", "name": "n", "kind": 2, "startTimeUnixNano": "x", "endTimeUnixNano": "5000000", "attributes": [attr("a", "1"), attr("b", "2"), attr("a", "3")]}
    payload = spark.read.schema(spans.PAYLOAD).json(spark.sparkContext.parallelize([json.dumps({"resourceSpans": [{"resource": {"attributes": [attr("service.name", "old"), attr("service.name", "svc")]}, "scopeSpans": [{"spans": [span]}]}]})]))
    row = telemetry.flatten_spans(payload).collect()[0]
    assert row["service"] == "svc" and row["attributes"] == {"a": "3", "b": "2"}
    rows = spark.createDataFrame([("t", 1, None, 10, 40.0), ("t", 2, 1, 20, 80.0), ("t", 3, 99, 5, 0.5)], "trace_id string, span_id long, parent_span_id long, start long, duration double")
    assert [r["span_id"] for r in telemetry.root_spans(rows).collect()] == [3]
    assert {r["span_id"]: r["percent"] for r in telemetry.trace_top_spans(rows).collect()} == {1: 4000.0, 2: 8000.0, 3: 50.0}


def test_batch_sizes(spark):
    from graphmill.operators import telemetry

    rows = [("k", i, 0.05 if i == 0 else 0.0, 100.0) for i in range(12)] + [("slow", 0, 0.0, 500.0), ("slow", 1, 0.0, 500.0), ("slow", 2, None, None)]
    out = telemetry.replayed_batch_sizes(spark.createDataFrame(rows, "k string, i int, error_rate double, millis_per_item double"), "k", "i")
    got = {k: [r["batch_size"] for r in out.where(f"k = '{k}'").orderBy("i").collect()] for k in ("k", "slow")}
    assert got == {"k": [10, 10, 10, 10, 10, 10, 15, 15, 22, 22, 33, 33], "slow": [10, 5, 5]}


def test_hybrid_search(spark):
    from graphmill.operators import search

    methods = spark.createDataFrame([(1, "p", "x.a.b.Shop", "buy", "@Cacheable", ["java.io.IOException"], "s", None, [1.0, 0.0]), (2, "p", "x.a.b.Shop", "sell", None, [], "s", "python", [0.9, 0.1]), (3, "q", "x.a.c.Bank", "pay", None, [], "s", "java", [0.0, 1.0])], "node int, project string, class_name string, method_name string, comment string, thrown array<string>, service string, language string, embedding array<double>")
    entries = spark.createDataFrame([(3, "/Pay/{id}")], "node int, path string")
    edges = spark.createDataFrame([(1, 3), (2, 1)], "src int, dst int")
    ask = lambda q, **how: [r["id"] for r in search.hybrid_search(methods, entries, edges, q, **how).collect()]
    assert ask("x.a.b.Shop.buy", depth=2) == [1]  # exact: not expanded
    assert ask("x.a.b.Shop") == ask("Shop") == [1, 2]
    assert ask("GET /pay/:x") == [3] and ask("@Cacheable") == [1] and ask("IOException") == [1]
    assert ask("sell", depth=1) == [1, 2] or ask("sell", depth=1) == [2, 1]
    assert ask("where can I buy things", vector=[1.0, 0.0]) == [1, 2]
    assert ask("where can I buy things", vector=[1.0, 0.0], language="java") == [1]
    assert ask("where can I buy things", vector=[1.0, 0.0], projects=["q"]) == []
    with pytest.raises(ValueError):
        ask("where can I buy things")


def test_louvain_ties_whatever_the_size(spark):
    """Rings of one weight: the same communities by name, however many nodes there are."""
    from graphmill.operators.graph import louvain

    def communities(n):
        rows = [("p", f"r{k:03d}_{i}", f"r{k:03d}_{(i + 1) % 6}", 1.0) for k in range(n) for i in range(6)]
        out = louvain(spark.createDataFrame(rows, "project string, src string, dst string, weight double"), most=10_000, least=1)
        return {r["node"]: r["community"] for r in out.collect()}

    few, many = communities(3), communities(120)
    same = lambda c, ring: tuple(c[f"r{ring:03d}_{i}"] - c[f"r{ring:03d}_0"] for i in range(6))
    assert {same(many, k) for k in range(120)} == {same(few, 0)}


def test_long_paths_and_many_rounds(spark):
    from graphmill.operators import graph

    edges = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.shortest_path(edges, 0, 30).collect()[0]["length"] == 30
    assert graph.shortest_path(edges, 0, 30, max_depth=20).count() == 0
    got = {r["node"]: r["depth"] for r in graph.reach_once(edges, spark.range(1).select(F.col("id").alias("seed"))).collect()}
    assert got == {k: k for k in range(61)}


def test_sinks(spark, tmp_path):
    from graphmill.sources import readers

    nodes = spark.createDataFrame([(1, "p", 5), (1, "p", 7), (2, "q", 1)], "id int, project string, v int")
    readers.write_nodes(nodes, f"{tmp_path}/nodes")
    readers.write_nodes(spark.createDataFrame([(1, "p", 9)], "id int, project string, v int"), f"{tmp_path}/nodes")
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/nodes").collect()) == [(1, 9), (2, 1)]
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "src int, dst int")
    ends = spark.createDataFrame([(1,), (2,)], "node int")
    for _ in range(2):
        readers.write_edges(edges, ends, f"{tmp_path}/edges")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/edges").collect()] == [(1, 2)]
    readers.export_reports(spark.createDataFrame([(1, "T", "body")], "report_id int, title string, body string"), f"{tmp_path}/md")
    assert "".join(r["value"] + "|" for r in spark.read.text(f"{tmp_path}/md").collect()).startswith("# T")


def test_files_of_classes(spark):
    from graphmill.operators import impact

    rows = spark.createDataFrame([("x\\src\\main\\java\\a\\B.java",), ("app/views.py",), ("README.md",), (None,), ("a/B.java",)], "f string")
    assert [r[0] for r in rows.select(impact.class_of_file(F.col("f"))).collect()] == ["a.B", "app.views", None, None, None]


def test_hybrid_search_falls_through(spark):
    """An exact kind without a hit is retried by name, then by the nearest descriptions; questions take tokens, then the whole, then keywords."""
    from graphmill.operators import search

    methods = spark.createDataFrame(
        [(1, "x.a.b.Shop", "buyAll", [1.0, 0.0], [0.0, 1.0]), (2, "x.a.b.Shop", "sell", [0.9, 0.1], [1.0, 0.0]), (3, "x.a.c.Bank", "payTicket", [-1.0, 0.0], [0.0, 1.0])], "node int, class_name string, method_name string, description_vector array<double>, code_vector array<double>"
    ).selectExpr("*", "'p' project", "null comment", "cast(array() as array<string>) thrown", "'s' service", "cast(null as string) language")
    entries, edges = spark.createDataFrame([(3, "/pay")], "node int, path string"), spark.createDataFrame([(1, 3), (2, 1)], "src int, dst int")
    east, north = (lambda _: [1.0, 0.0]), (lambda _: [0.0, 1.0])
    ask = lambda q, **how: [(r["id"], r["score"]) for r in search.hybrid_search(methods, entries, edges, q, **how).collect()]
    assert ask("com.a.b.Nope.run") == [] and ask("GET /none") == []
    assert [i for i, _ in ask("com.a.b.Nope.run", embed=east, depth=2)] == [1, 2]  # relaxed, not expanded
    assert [i for i, _ in ask("x.a.b.Shop.sell", embed=north, depth=2)] == [2]  # a hit ends it
    assert [i for i, _ in ask("All", embed=north)] == [1]  # no class All: methods with it in their names
    assert [i for i, _ in ask("SELECT a FROM b", embed=east, k=5, statements=spark.createDataFrame([(3, 7, [1.0, 0.0]), (1, 8, [0.0, 1.0])], "node int, sql_id int, embedding array<double>"))] == [3]
    assert [i for i, _ in ask("public void run() { return x; }", embed=north)] == [1, 3]  # the nearest code
    found = dict(ask("how does one buy a Ticket", embed=east, k=5))
    assert list(found) == [1, 2, 3] and found[3] == 0.1 and found[1] > found[2] > 0.05  # keyword last
    far = dict(ask("who did it", embed=lambda _: [0.45, -0.9], k=5))
    assert list(far) == [1, 2] and 0.3 <= far[2] < far[1] < 0.5  # no token near enough: relaxed
    assert ask("who did it", embed=north, k=5) == []
    assert search.search_keywords("how does the ab, Ticket。支付 x for one two three four") == ["how", "does", "Ticket", "支付", "one"]
    assert search.search_keywords("") == search.search_keywords(None) == []


def test_span_tree_with_repeats_and_cycles(spark):
    """Repeated rows count once; the least span of a parent cycle is its root, and what hangs below it keeps its place."""
    schema = "trace_id string, span_id string, parent_span_id string"
    chain = [("t", f"s{k}", f"s{k - 1}" if k else None) for k in range(6)]
    loop = [("u", "b", "c"), ("u", "c", "d"), ("u", "d", "b"), ("u", "x", "c"), ("u", "y", "x"), ("v", "own", "own"), ("v", "z", "own"), ("w", None, "q"), (None, "q", None)]
    two = [("z", "k1", "k2"), ("z", "k2", "k1"), ("z", "m1", "m2"), ("z", "m2", "m1"), ("z", "r", None), ("z", "below", "r")]
    tree = graph.span_tree(spark.createDataFrame([*chain, *chain, *loop, *two], schema))
    assert {tuple(r) for r in tree.collect()} == {
        *(("t", f"s{k}", f"s{k - 1}" if k else None, k) for k in range(6)), ("u", "b", None, 0), ("u", "d", "b", 1), ("u", "c", "d", 2), ("u", "x", "c", 3), ("u", "y", "x", 4), ("v", "own", None, 0), ("v", "z", "own", 1),
        ("z", "k1", None, 0), ("z", "k2", "k1", 1), ("z", "m1", None, 0), ("z", "m2", "m1", 1), ("z", "r", None, 0), ("z", "below", "r", 1),
    }
    assert tree.count() == 19
    assert graph.span_tree(spark.createDataFrame([], schema)).count() == 0
    spans = spark.createDataFrame([("a", 1, 2, 5.0), ("a", 2, 1, 4.0), ("b", 3, None, 9.0), ("b", 4, 3, 1.0)], "trace_id string, span_id int, parent_span_id int, start double")
    assert {(r["trace_id"], r["span_id"]) for r in telemetry.root_spans(spans).collect()} == {("a", 2), ("b", 3)}


def test_entries_with_a_hot_method_name(spark):
    """Many classes have a method get: the third step meets in the rarest three characters."""
    rows = [(k, f"com.shop.part{k:04d}.Store", "get") for k in range(600)] + [(9000, "com.rare.Zq", "get"), (9001, "com.rare.Zq", "put"), (9002, None, "get")]
    methods = spark.createDataFrame(rows, "node int, class_name string, method_name string")
    asked = spark.createDataFrame([(1, "part0599", "get"), (2, "re.Z", "get"), (3, "nowhere", "get"), (4, "Zq", "get"), (5, "0.", "get"), (6, "Store$X", "get"), (7, None, "get"), (8, "rt00", "none")], "ask_id int, class_name string, method_name string")
    got = {r["ask_id"]: (r["node"], r["step"]) for r in impact.resolved_entries(asked, methods).collect()}
    assert got == {1: (599, 3), 2: (9000, 3), 4: (9000, 2), 5: (0, 3)}


def test_inherited_levels(spark):
    """Diamonds, cycles and repeats: the nearest ancestor's, the least of several."""
    extends = spark.createDataFrame([("D", "B"), ("D", "C"), ("B", "A"), ("C", "A"), ("C", "A"), ("X", "Y"), ("Y", "X"), ("E", "D"), ("S", "S")], "child string, parent string")
    methods = spark.createDataFrame([("A", "f"), ("C", "g"), ("B", "g"), ("B", "g"), ("X", "h"), ("D", "k"), ("S", "s")], "owner string, method string")
    got = {tuple(r) for r in incremental.inherited_methods(extends, methods, 10).collect()}
    assert got == {("B", "f", "A"), ("C", "f", "A"), ("D", "f", "A"), ("D", "g", "B"), ("E", "f", "A"), ("E", "g", "B"), ("E", "k", "D"), ("Y", "h", "X")}
    assert {tuple(r) for r in incremental.inherited_methods(extends, methods, 1).collect()} == {("B", "f", "A"), ("C", "f", "A"), ("D", "g", "B"), ("E", "k", "D"), ("Y", "h", "X")}


def test_latest_per_key(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, None, "c"), (None, 1, "d"), (2, None, "e")], "k int, at int, v string")
    assert {tuple(r) for r in telemetry.latest_per_key(rows, "k", "at").collect()} == {(1, 7, "b"), (None, 1, "d"), (2, None, "e")}
