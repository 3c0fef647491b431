import pytest

from diffusio.graph import Graph, Signal
from diffusio.operators import filters as O
from diffusio.sources import loaders as L
from diffusio.streaming.edges import StreamRanker


def write(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_pairs_and_groups(spark, tmp_path):
    data = tmp_path / "toy"
    data.mkdir()
    write(data, "pairs.txt", "# comment\nA B x\nB\tC\nC D\n\nlone\n")
    write(data, "groups.txt", "#\nA B Z\nC\nD C B A")
    L.register("toy")
    ((name, graph, groups),) = L.load_multiple(spark, str(tmp_path), ["toy"], least=2)
    assert name == "toy" and graph.number_of_edges() == 3
    assert {(r[0], r[1]) for r in groups.collect()} == {(0, "A"), (0, "B"), *((1, x) for x in "ABCD")}
    assert len(list(L.load_all_communities(spark, str(tmp_path), ["toy"], least=2))) == 2
    assert next(iter(L.load_one_community(spark, str(tmp_path), ["toy"], least=2)))[2].count() == 4
    assert next(iter(L.load_graphs(spark, str(tmp_path), ["toy"]))).number_of_nodes() == 4
    L.write_pairs(graph.edges.select("src", "dst"), str(tmp_path / "out"))
    assert L.read_pairs(spark, str(tmp_path / "out")).count() == 6
    L.write_groups(groups, str(tmp_path / "groups"))
    assert L.read_groups(spark, str(tmp_path / "groups"), graph.nodes, least=1).count() == 6


def test_features(spark, tmp_path):
    got = {r[0]: r[1] for r in L.read_features(spark, write(tmp_path, "f.txt", "a 1 2 1\nb 3\n")).collect()}
    assert got == {"a": [1, 2, 1], "b": [3, 0, 0]}
    sparse = L.read_features(spark, write(tmp_path, "s.txt", "a 0=1 3=2\nb 1=4\n"))
    assert {r[0]: r[1] for r in sparse.collect()} == {"a": [1, 0, 0, 2], "b": [0, 4, 0, 0]}
    assert {r[0]: r[1] for r in L.normalized_features(sparse).collect()}["a"] == [1 / 3, 0, 0, 2 / 3]
    assert L.features_to_groups(sparse).count() == 3
    labels = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, label string")
    assert {r[0]: r[1] for r in L.one_hot(labels).collect()} == {"a": [1, 0], "b": [0, 1]}


def test_other_formats(spark, tmp_path):
    nodes, edges = L.read_gml(spark, write(tmp_path, "g.gml", 'graph [\n node [\n id 1\n value "x"\n ]\n node [ id 2 value 0 ]\n edge [\n source 1\n target 2\n ]\n]\n'))
    assert {(r[0], r[1]) for r in nodes.collect()} == {("1", "x"), ("2", "0")} and [tuple(r) for r in edges.collect()] == [("1", "2")]
    pairs, groups = L.read_product_records(spark, write(tmp_path, "p.txt", "Id: 1\nASIN: 11\n  group: Book\n  similar: 2 12  13\n\nId: 2\nASIN: 12\n  group: DVD\n  similar: 0\n"))
    assert {tuple(r) for r in pairs.collect()} == {("11", "12"), ("11", "13")} and groups.count() == 2
    rows = L.read_profile_groups(spark, write(tmp_path, "pr.txt", "u1\t1\tlikes dogs\nu2\t0\tcats\n"), {"flag": 1}, {"dogs": 2, "cats": 2})
    assert {tuple(r) for r in rows.collect()} == {("flag", "u1"), ("dogs", "u1"), ("cats", "u2")}


def test_stream(spark, tmp_path):
    for i, pairs in enumerate(([("A", "B"), ("B", "C")], [("C", "D"), ("A", "B")])):
        spark.createDataFrame(pairs, "a string, b string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    r = StreamRanker(O.PageRank(0.3, tol=1e-7), lambda g: Signal.of(g, ["A"]), sink=lambda df, k: seen.append(k))
    stream = spark.readStream.schema("a string, b string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    r.start(stream, str(tmp_path / "state")).awaitTermination()
    whole = O.PageRank(0.3, tol=1e-7)(Graph.from_pairs(spark, ["AB", "BC", "CD"]), ["A"]).to_dict()
    got = {x["id"]: x["value"] for x in r.scores(spark).collect()}
    assert seen and all(abs(got[k] - whole[k]) < 1e-5 for k in whole)


def test_a_restarted_stream_goes_on_with_all_edges(spark, tmp_path):
    def run(*pairs):
        spark.createDataFrame([tuple(p) for p in pairs], "a string, b string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        r = StreamRanker(O.PageRank(0.3, tol=1e-7), lambda g: Signal.of(g, ["A"]))
        r.start(spark.readStream.schema("a string, b string").parquet(str(tmp_path / "in")), str(tmp_path / "state")).awaitTermination()
        return r

    run("AB", "BC")
    r = run("CD", "AB")
    assert r.graph(spark).number_of_edges() == 3
    whole = O.PageRank(0.3, tol=1e-7)(Graph.from_pairs(spark, ["AB", "BC", "CD"]), ["A"]).to_dict()
    got = {x["id"]: x["value"] for x in r.scores(spark).collect()}
    assert all(abs(got[k] - v) < 1e-4 for k, v in whole.items())


def test_folders_and_feature_datasets(spark, tmp_path):
    place = tmp_path / "second" / "graph5"
    place.mkdir(parents=True)
    (place / "pairs.txt").write_text("A B\nB C\n")
    (place / "groups.txt").write_text("A B\nC")
    (place / "features.txt").write_text("A 1 3\nB 2\nX 1")
    folders = [str(tmp_path / "first"), str(tmp_path / "second")]
    assert L.resolve(spark, "graph5", folders) == str(place) and L.available(spark, folders) == ["graph5"] and "graph5" in L.SMALL
    with pytest.raises(FileNotFoundError):
        L.resolve(spark, "graph9", folders)
    graph, features, groups = L.read_feature_dataset(spark, str(place), least=1)
    assert {r["id"]: r["features"] for r in features.collect()} == {"A": [0.25, 0.75], "B": [1.0, 0.0]}
    assert sorted(tuple(r) for r in groups.collect()) == [(0, "A"), (0, "B"), (1, "C")] and graph.number_of_nodes() == 3
