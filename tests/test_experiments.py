"""Evaluation with reuse, splits, sinks, parsers and displays: round trips and small cases by hand."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import params as P
from corvane.operators import display, evaluate, flatten, metrics, solve, splits, statistics, summaries
from corvane.sources import graphs, outputs, papers

EDGES = [(0, 1), (1, 2), (2, 0), (0, 3), (3, 4), (4, 5), (5, 3), (1, 0)]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [(i, i % 2, i not in (0, 3), i == 0, i == 3) for i in range(6)]
    return spark.createDataFrame(EDGES, "source long, target long"), spark.createDataFrame(nodes, "node_id long, label int, train boolean, val boolean, test boolean")


def test_params():
    assert P.canonical_json({"b": 1, "a": [2]}) == '{"a":[2],"b":1}' and P.canonical_json(None) == "{}"
    one = P.Evaluation({"k": 3}, forbidden=(2, 1), solver_config={"max_in_edges": 0})
    assert one.stored["_eval"]["forbidden_hash"] == P.node_set_hash([1, 2]) != P.node_set_hash([1]) and one.key == P.digest(json.dumps(one.stored, sort_keys=True))
    assert one.question == P.Evaluation({"k": 3}, weighting="uniform", solver_config={"max_in_edges": 0}).question != P.Evaluation({"k": 3}).question
    assert len(P.grid("bp", k=[3, 4], kappa=[0, 1])) == 4 and P.grid("bfs", bfs_depth=[1], k=[3])[0]["bfs_use_k"] and P.seeds_of("bfs") == [None]
    for bad in ({"method": "x"}, {"method": "bp", "k": 1}, {"method": "bp", "k": 3, "kappa": -1}, {"method": "bfs"}, {"method": "avgdeg", "kappa": 1}, {"method": "avgdeg", "bfs_depth": 1}, {"method": "bp", "k": 3, "max_in_edges": -1}):
        with pytest.raises(ValueError):
            P.SolveParams(**bad).validate()


def test_evaluation_caches_and_reuses(spark, graph, tmp_path):
    edges, nodes = graph
    queries = spark.createDataFrame([(0,), (3,)], "query_node long")
    asked = []

    def solver(e, q, p):
        asked.append(sorted(r.query for r in q.collect()))
        return evaluate.run_solver(e, q, p)

    path = str(tmp_path / "records")
    run = lambda split_hash, weighting="uniform", qs=queries: {r.query_node: r for r in evaluate.evaluate_nodes(qs, edges, nodes, "bfs", {"bfs_depth": 1, "k": 3}, "d", "val", split_hash, path, weighting=weighting, solver=solver).collect()}
    first = run("s1", qs=queries.where("query_node = 0"))
    assert set(first[0].retrieved_nodes) == {0, 1, 3} and first[0].predicted_label == 1 and not first[0].fallback_used and first[0]["size"] == 3
    both = run("s1")
    assert asked == [[0], [3]] and both[0].ord == 1 and both[3].ord == 2 and set(both[3].retrieved_nodes) >= {3, 4}
    again = run("s1")
    assert asked[2] == [] and {q: r.retrieved_nodes for q, r in again.items()} == {q: r.retrieved_nodes for q, r in both.items()}
    other = run("s2", "distance")
    assert asked[3] == [] and all(r.reused_solver_record and r.reused_from_split_hash == "s1" for r in other.values())
    stored = evaluate.read_evaluations(spark, path)
    assert stored.count() == 4
    q = both[0].qualities
    assert q["size"] == 3 and q.dir_internal_edge_density == pytest.approx(3 / 6) and q.edge_connectivity == 1
    a = evaluate.averages(stored).first()
    assert a.query_count == 4 and a.avg_pred_size == pytest.approx(sum(r["size"] for r in stored.collect()) / 4)


@pytest.mark.parametrize("method, params", [("bp", {"k": 3, "kappa": 0}), ("avgdeg", {"k": 3})])
def test_evaluation_by_each_method(spark, graph, method, params):
    edges, nodes = graph
    found = evaluate.evaluate_nodes(spark.createDataFrame([(0,)], "query_node long"), edges, nodes, method, params, "d", "val", "s", seed=42).first()
    assert set(found.retrieved_nodes) == {0, 1, 2} if method == "bp" else 0 in found.retrieved_nodes
    assert found.seed == (42 if method == "bp" else None)


def test_sweep(spark, graph):
    edges, nodes = graph
    m = evaluate.sweep(spark, "d", {"bfs": {"bfs_depth": [0, 1], "k": [2]}}, None, "")
    m = m.withColumn("records_dir", F.lit(""))
    queries = {"val": spark.createDataFrame([(0,)], "query_node long"), "test": spark.createDataFrame([(3,)], "query_node long")}
    assert evaluate.run_sweep(m, queries, {"val": "v", "test": "t"}, edges, nodes).count() == 4


def test_split_meta(spark, graph, tmp_path):
    edges, nodes = graph
    meta = splits.split_meta("d", 42, nodes, edges, nodes.where("test"), nodes.where("val OR test"))
    splits.write_split_meta(spark, meta, str(tmp_path / "m"))
    back = splits.read_split_meta(spark, str(tmp_path / "m"))
    assert back == json.loads(json.dumps(meta)) and back["splits"]["val"] == {"size": 1, "hash": P.node_set_hash([0])} and back["edges_hash"] == P.edge_list_hash(EDGES)
    assert splits.check_split_meta(back, nodes, edges) == back
    for wrong in ({"schema_version": "2"}, {"edges_hash": "x"}, {"splits": back["splits"] | {"val": {"size": 1, "hash": "x"}}}):
        with pytest.raises(ValueError):
            splits.check_split_meta(back | wrong, nodes, edges)
    rows = [("d", "bfs", "h", None, "val", 0, back["splits"]["val"]["hash"])]
    rec = spark.createDataFrame(rows, "dataset string, method string, params_hash string, seed int, query_split string, query_node long, split_hash string")
    splits.validate_split_hash(rec, {"d": back})
    with pytest.raises(RuntimeError, match="another split"):
        splits.validate_split_hash(rec.withColumn("split_hash", F.lit("old")), {"d": back})
    with pytest.raises(RuntimeError, match="0/1"):
        splits.validate_complete(rec, {"d": back})
    splits.validate_complete(rec, {"d": back}, allow_partial=True)
    splits.validate_complete(rec.union(rec.withColumns({"query_split": F.lit("test"), "query_node": F.lit(3).cast("long")})), {"d": back})


def test_sinks_and_parsers(spark, tmp_path):
    out = outputs.payload_line({"query_node": "5", "nodes": ["5", "x", "6"], "size": 3, "method": "bp", "wall_time_s": 1.5})
    runs = spark.createDataFrame([(f"API Queries Made : 12\n{out}\nend", 0)], "stdout string, returncode int")
    r = outputs.run_rows(runs).first()
    assert (r.query_node, r.retrieved_nodes, r.oracle_queries, r.wall_time_s) == (5, [5, 6], 12, 1.5)
    for bad in (("none", 0), (out, 1), ("JSON_RESULT:[1]", 0)):
        with pytest.raises(Exception, match="solver run failed"):
            outputs.run_rows(spark.createDataFrame([bad], "stdout string, returncode int")).collect()
    outputs.sink_nodes_csv(spark.createDataFrame([(3,), (4,)], "node long"), str(tmp_path / "n.csv"))
    assert sorted(x.node_id for x in outputs.read_predicted_nodes(spark, str(tmp_path / "n.csv")).collect()) == [3, 4]
    assert outputs.read_predicted_nodes(spark, str(tmp_path / "none.csv")).count() == 0
    outputs.sink_csv(spark.createDataFrame([(1,)], "x int"), str(tmp_path / "x.csv"))
    assert outputs.read_predicted_nodes(spark, str(tmp_path / "x.csv")).count() == 0
    outputs.sink_json(spark.createDataFrame([(float("nan"), None)], "a double, b string"), str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"a": None, "b": None}


def test_synthetic_trees_and_datasets(spark, tmp_path):
    root = str(tmp_path / "syn")
    for seed in (0, 1):
        graphs.write_gnp(spark, root, 6, 0.5, seed)
    meta, edges = graphs.scan_synthetic_tree(spark, root)
    assert {r.seed for r in meta.collect()} == {0, 1} and {r.seed: r.edge_count_directed for r in meta.collect()} == {r.seed: r["count"] for r in edges.groupBy("seed").count().collect()}
    assert {r.seed for r in graphs.scan_synthetic_tree(spark, root, [1])[0].collect()} == {1}
    for name, files in (("a", ("nodes.csv", "edge.csv")), ("b", ("nodes.csv",))):
        (tmp_path / "data" / name).mkdir(parents=True)
        for f in files:
            (tmp_path / "data" / name / f).write_text("node_id,label,train,val,test\n0,0,True,False,False\n1,4,True,False,False\n" if f == "nodes.csv" else "source,target\n0,1\n")
    assert [(r.dataset, r.nodes, r.classes) for r in graphs.list_datasets(spark, str(tmp_path / "data")).collect()] == [("a", 2, 5)]


def test_oracle_and_context(spark, graph):
    edges, nodes = graph
    told = graphs.TableOracle(edges, 1).query(spark.createDataFrame([(9, 0)], "query long, node long")).collect()
    assert sorted((r.side, r.neighbour) for r in told) == [(0, 1), (1, 1), (1, 3)]
    c = graphs.build_graph_context(edges)
    assert c.directed.count() == 8 and c.undirected.count() == 14 and c.fallback is c.directed and graphs.build_graph_context(edges, 5).fallback.count() == 14
    lists, out, total = graphs.sim_dataset(edges, nodes)
    assert {r.node: r.neighbours for r in lists.collect()}[0] == [1, 1, 2, 3] and {r.node: r.successors for r in out.collect()}[0] == [1, 3] and (total.first().num_classes, total.first().total_volume) == (2, 16)


def test_displays(spark):
    rows = [("q", "1", 7, 1, 2, "core", "N/A", None), ("q", "2", 5, 2, 1, "core", "2001-05-06", 2001), ("q", "g", 9, None, 0, "ghost", None, None)]
    shown = spark.createDataFrame(rows, "query string, id string, raw_id long, display_num int, label int, type string, date string, year int")
    assert [r.id for r in display.ledger_sort(shown, "label").collect()] == ["2", "1"] and [r.id for r in display.ledger_sort(shown, "year").collect()] == ["1", "2"] and [r.id for r in display.ledger_sort(shown, "id", True).collect()] == ["2", "1"]
    at = {r.id: r.e for r in shown.select("id", display.epoch(F.col("date"), F.col("year")).alias("e")).collect()}
    assert at["1"] == 946684800000 and at["2"] == 989107200000
    assert [(r.id, r.rank, r.row) for r in display.layout_rank(shown).orderBy("rank").collect()] == [("2", 0, 0), ("1", 1, 1)]
    text = {r.x: r.s for r in spark.createDataFrame([(0.0,), (0.00012345,), (1234567.0,), (-2.5,), (None,), (999.99999999,)], "x double").select("x", display.show_float(F.col("x"), 3).alias("s")).collect()}
    assert text == {0.0: "0.000", 0.00012345: "1.235e-4", 1234567.0: "1.235e+6", -2.5: "-2.500", None: None, 999.99999999: "1000.000"} or text[0.00012345] == "1.234e-4"
    s = spark.range(1).select(display.show_int(F.lit(1234567)).alias("i"), display.show_spread(F.lit(0.5), F.lit(0.25)).alias("s"), display.show_spread(F.lit(None).cast("double"), F.lit(0.1)).alias("p")).first()
    assert tuple(s) == ("1,234,567", r"$0.500 \pm 0.250$", "(pending)")


def test_papers(spark):
    r = spark.createDataFrame([("https://x.org/W1 ", "a b/c*~")], "u string, t string").select(papers.extract_id(F.col("u")).alias("i"), papers.url_encode(F.col("t")).alias("e"), papers.strip_doi(F.lit("https://doi.org/10.1/x")).alias("d")).first()
    assert tuple(r) == ("W1", "a%20b%2Fc%2A~", "10.1/x")


def test_grouped_statistics(spark):
    rows = [(c, k, q, q % 3, (q + (c == "b") * (q % 2)) % 3, "g") for c, k in (("a", 3), ("b", 3)) for q in range(30)]
    df = spark.createDataFrame(rows, "cell string, cell_k int, query_node long, truth int, predicted int, g string")
    ci = {r.cell: r for r in statistics.bootstrap_ci(df, ["cell"], draws=50).collect()}
    assert ci["a"].f1 == pytest.approx(1) == ci["a"].f1_ci_lo and ci["b"].f1_ci_lo <= ci["b"].f1 <= ci["b"].f1_ci_hi and ci["b"].n == 30
    ties = {(r.cell, r.metric): r for r in statistics.bootstrap_ties(df, ["g"], 50).collect()}
    assert ties["a", "f1"].overall_best and not ties["b", "f1"].overall_tied and ties["a", "f1"].n_queries == 30
    pair = {r.cell: r for r in statistics.paired_ci(df.withColumn("seed", F.lit(1)), ["g"], draws=50, by_seed="seed").collect()}
    assert pair["a"].f1_lo < 1 and pair["a"].f1_hi == pytest.approx(1)
    w = statistics.wilcoxon(spark.createDataFrame([("x", float(i)) for i in range(1, 6)] + [("y", 0.0), ("y", 0.0), ("z", 1.0)], "m string, delta double"), ["m"])
    assert {r.m: r.p for r in w.collect()} == {"x": pytest.approx(0.0625), "y": 1.0, "z": None}


def test_summary_of_few_rows(spark):
    hard = spark.createDataFrame([], "query_node long")
    recs = spark.createDataFrame([(1, "test"), (2, "val")], "query_node long, query_split string")
    assert summaries.filter_hard_subset(recs, hard).count() == 2
    assert [r.query_node for r in summaries.filter_hard_subset(recs, spark.createDataFrame([(5,)], "query_node long")).collect()] == [2]
    assert flatten.safe_name("a b--c_") == "a_b--c".replace("--", "_")


def test_qualities_of_a_hand_made_community(spark, graph):
    edges, nodes = graph
    members = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "query long, node long")
    q = evaluate.measure(members, edges, nodes).first().qualities
    cut = solve.cut_qualities(solve.inside(edges, members)).first()
    assert (q.edge_connectivity, cut.edge_connectivity) == (2, 2) and q.undir_external_expansion == pytest.approx(1 / 3) and q.undir_external_conductance == pytest.approx(1 / 7)
    assert metrics.reference_only_qualities(edges, members).first().num_edges == 4


def test_seeds_collapse_to_medians_without_gathering_ones_and_twos(spark):
    import re
    import statistics as plain

    values = {q: [None if (q + i) % 6 == 5 else float((7 * q + 3 * i) % 11) for i in range(q % 5 + 1)] for q in range(40)}
    rows = [("d", "bp", None if q % 3 else "h", "val", q, i, v) for q, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "dataset string, method string, params_hash string, query_split string, query_node long, ord long, v double")
    got = summaries.collapse_quality_seeds(flatten.quality_rows(df.withColumn("qualities", F.struct(F.col("v").alias("size"))))).select("query_node", "size")
    want = {q: plain.median(known) if (known := [v for v in vs if v is not None]) else None for q, vs in values.items()}
    assert {r.query_node: r["size"] for r in got.collect()} == want and got.count() == len(values)
    assert re.search(r"(?<!Object)HashAggregate\(keys=\[_key", got._jdf.queryExecution().toString())
