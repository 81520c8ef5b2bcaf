"""Readers, writers and streams."""

import json

from pyspark.sql import functions as F

from corvane.operators import expand, records, solve
from corvane.sources import graphs
from corvane.streaming import packets


def test_edges_csv_keeps_order_and_cuts_at_first_comma(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source,target\na,b\nnone\nb,c,d\r\na,b\n")
    rows = graphs.read_edges_csv(spark, str(tmp_path / "e.csv")).orderBy("edge_ord").collect()
    assert [(r.source, r.target) for r in rows] == [("a", "b"), ("b", "c,d"), ("a", "b")]


def test_nodes_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text("node_id,label,val,test,train\n1,2,true,False,True\n2,0,False,true,False\n3,1,False,False,False\n")
    rows = {r.node_id: r.split for r in graphs.read_nodes_csv(spark, str(tmp_path / "n.csv")).collect()}
    assert rows == {1: "train", 2: "test", 3: "unlabeled"}


def test_records_tree(spark, tmp_path):
    for folder, text in (("a", '{"x": 1}\n\nbad\n'), ("b.bak", '{"x": 2}\n')):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "records.ndjson").write_text(text)
    good, bad = records.read_records(spark, str(tmp_path), "x int")
    assert [r.x for r in good.collect()] == [1] and bad.count() == 1


def test_small_scalars(spark):
    df = spark.createDataFrame([("a b--c_",)], ["c"]).select(records.safe_col(F.col("c")).alias("s"), records.finite(F.lit(float("nan"))).alias("f"), records.relative_gap(F.lit(2.0), F.lit(1.0)).alias("g"))
    r = df.first()
    assert (r.s, r.f, r.g) == ("a_b_c", None, 1.0)


def test_abstract(spark):
    df = spark.createDataFrame([(1, {"b": [1, 3], "a": [0]})], "id long, m map<string, array<int>>")
    assert records.abstract_text(df, "id", "m").first().text == "a b  b"


def test_forbidden_nodes_are_never_entered(spark):
    arcs = expand.revealed(spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "source long, target long"))
    queries = spark.createDataFrame([(0,)], "query long")
    get = lambda no: {r.node: r.distance for r in expand.bfs_distances(arcs, queries, 10, spark.createDataFrame(no, "node long")).collect()}
    assert get([(2,)]) == {0: 0, 1: 1} and get([]) == {0: 0, 1: 1, 2: 2, 3: 3} and get([(0,)]) == {0: 0, 1: 1, 2: 2, 3: 3}


def test_query_pool(spark):
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (10, 11), (10, 12), (11, 12)]
    assert [r.query for r in solve.query_pool(spark.createDataFrame(edges, "source long, target long")).collect()] == [0]


def test_gnp_is_symmetric(spark):
    edges, q = graphs.generate_gnp(spark, 8, 0.5, 1)
    pairs = {(r.source, r.target) for r in edges.collect()}
    assert pairs and all((b, a) in pairs for a, b in pairs) and 0 <= q < 8


def test_stream_of_packets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ["iteration 1 ", packets.PREFIX + json.dumps({"bb_node": 3, "density": 0.5, "size": 4}), packets.PREFIX + "{broken"]
    (tmp_path / "in" / "log.txt").write_text("\n".join(lines))
    q = packets.packets(packets.read_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("pk").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.type for r in spark.table("pk").collect()) == ["incumbent", "log", "log"]


def test_telemetry_state(spark, tmp_path):
    rows = [("s", 1, "log", "x"), ("s", 2, "incumbent", '{"bb_node": 5, "density": 0.25, "size": 3}'), ("s", 3, "incumbent", '{"bb_node": 4, "density": 0.5, "size": 4}')]
    schema = "session string, seq long, type string, content string"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = packets.fold_telemetry(stream).writeStream.outputMode("update").format("memory").queryName("tm").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("tm").collect()[-1]
    assert (r.bb_nodes, r.incumbent_obj, r["size"], r.status) == (5, None, 4, "running")


LOG = [
    "[2024-01-02 03:04:05,678] === DINKELBACH ITERATION 3 | Lambda = 0.25 ===", "Init Active Set | Size: 7 | Density: 0.5", "  -> Nodes Explored : 2 (Total: 11)", "  -> LP Solves : 4 (Total: 9)",
    "Incumbent updated at Node 5 | Obj: 1.5 | Size: 6", "Found Solution : Size: 8 | New Density: 7.5e-1", "Blacklisting node n1 during pricing : timeout", "Blacklisting node n1 : again", "Blacklisting node n2 : gone",
    "Columns Generated   : 21", "BQP Cuts Added  : 3", "Total Solver Time : 2.5s", "Density : 0.875", "Size : 9", "nothing", "Status : Converged",
]


def test_telemetry_of_a_log_in_batch_and_line_by_line(spark):
    state = {}
    for line in LOG:
        state = packets.fold_line(state, line)
    barred = state.pop("blacklisted")
    assert [(b["id"], b["phase"], b["reason"]) for b in barred] == [("n1", "pricing", "timeout"), ("n2", None, "gone")]
    want = {"iteration": 3, "lambda": 0.75, "size": 9, "bb_nodes": 11, "lp_solves": 9, "incumbent_obj": 1.5, "incumbent_size": 6, "columns_generated": 21, "cuts_added": 3, "solver_time": 2.5, "density": 0.875, "status": "converged"}
    assert state == want
    df = spark.createDataFrame([("s", i, "log", line) for i, line in enumerate(LOG)], "session string, seq long, type string, content string")
    row = packets.telemetry_snapshot(df).first()
    assert {k: row[k] for k in want} == want and [b.id for b in row.blacklisted] == ["n1", "n2"]


def test_line_classes(spark):
    lines = {"=" * 12: "header", "-" * 12: "separator", "a [!] Error": "warn", "Incumbent updated": "incumbent", "[2024-01-02 03:04:05,678] DINKELBACH ITERATION": "iteration", "Pruned node 3": "prune", "Graph built": "success", "an exception": "error", "======": "info"}
    df = spark.createDataFrame([(k,) for k in lines], "v string")
    assert {r.v: r.c for r in df.select("v", packets.classify_line(F.col("v")).alias("c")).collect()} == lines


def test_debounce(spark):
    rows = [("s", i, "incumbent", json.dumps({"nodes": n}), at) for i, (n, at) in enumerate([(["a"], 0), (["a"], 100), (["b"], 200), (["c"], 900), ([], 950), (["d"], 1300)])]
    df = spark.createDataFrame(rows, "session string, seq long, type string, content string, at_ms long")
    assert [r.seq for r in packets.distinct_incumbents(df).orderBy("seq").collect()] == [0, 2, 3, 5]
    assert [r.seq for r in packets.debounced_incumbents(df).orderBy("seq").collect()] == [2, 3, 5]


def test_packets_are_written_as_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.txt").write_text("plain\n" + packets.PREFIX + '{"size": 4}')
    packets.write_packets(packets.packets(packets.read_lines(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [{"type": "log", "content": "plain"}, {"type": "incumbent", "content": {"size": 4}}]))
