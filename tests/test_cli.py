import json

from lattica.__main__ import run


def test_commands(spark, tmp_path):
    text = tmp_path / "arcs.tsv"
    text.write_text("# two columns\n0\t1\n1\t2\n2\t0\n2\t0\nshort\n2\t3\n")
    at = lambda x: str(tmp_path / x)
    assert run(spark, ["from-arcs", str(text), at("g")]) == 0
    rows = lambda x: sorted(map(tuple, spark.read.parquet(at(x)).collect()))
    assert rows("g") == [(0, 1), (1, 2), (2, 0), (2, 3)]
    assert run(spark, ["symmetrize", at("g"), at("s"), "--no-loops"]) == 0
    assert run(spark, ["check-symm", at("s")]) == 0 and run(spark, ["check-symm", at("g")]) == 1
    assert run(spark, ["check-eq", at("g"), at("g")]) == 0 and run(spark, ["check-eq", at("g"), at("s")]) == 1
    assert run(spark, ["sccs", at("g"), at("c")]) == 0 and rows("c") == [(0, 0), (1, 0), (2, 0), (3, 3)]
    run(spark, ["from-arcs", str(text), at("n"), "--labels"])
    assert rows("n.nodes") == [(0, "0"), (1, "1"), (2, "2"), (3, "3")]
    numbers = tmp_path / "n.txt"
    numbers.write_text("5\n\n7\n")
    run(spark, ["seq", str(numbers), at("j")])
    assert json.loads("".join(r[0] for r in spark.read.text(at("j")).collect())) == [5, 7]
