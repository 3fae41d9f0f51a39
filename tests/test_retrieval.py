from orrery import cli
from orrery.operators import retrieval as R


def test_graph_chunks_are_all_there(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    # Symbols 1 to 4 are in file 1, 5 is in 2; file 1 imports 10 to 39, file 10 imports 50. The first lines have no chunk.
    file_of = df([(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)], "node long, file_id long")
    edges = df([(1, 5, "exact"), (2, 1, "heuristic")], "src long, dst long, resolution string")
    imports = df([(1, f) for f in range(10, 40)] + [(10, 50)], "src_file long, dst_file long")
    chunks = [(102, 1, 1), (103, 2, 1), (104, 3, 1), (202, 5, 2), (203, None, 2)] + [(f * 100 + i, None, f) for f in [*range(10, 40), 50, 60] for i in (2, 3)]
    got = R.graph_chunks(edges, imports, df([(1,)], "node long"), file_of, df(chunks, "chunk_id long, symbol_id long, file_id long"))
    want = {202: 0, 103: 1, 102: 2, 104: 2} | {f * 100 + i: 3 for f in range(10, 40) for i in (2, 3)} | {5002: 4, 5003: 4}
    assert {r.chunk_id: r.priority for r in got.collect()} == want
    ranked = R.ranked_all(got, "graph", "priority", "chunk_id", offset=120)
    assert [r.chunk_id for r in ranked.orderBy("rank").collect()] == sorted(want, key=lambda c: (want[c], c))
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(len(want)))


def test_search_has_every_named_symbol(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    for i in range(25):
        (tmp_path / "src" / f"m{i}.py").write_text(f"def parse_amount(text):\n    return int(text) + {i}\n")
    cli.main([f"--store={tmp_path}/out", "index", str(tmp_path / "src")])
    found = cli.search(spark, f"{tmp_path}/out", "where is parse_amount", 100)
    assert {f"m{i}.parse_amount" for i in range(25)} <= {r["title"] for r in found}
