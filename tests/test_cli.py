import json

from orrery import cli


def test_index_and_queries(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    (src / "util.py").write_text("def parse_amount(text):\n    return int(text)\n")
    (src / "order.py").write_text("from .util import parse_amount\n\nclass OrderService:\n    def total(self, items):\n        return parse_amount(items)\n\ndef main():\n    return parse_amount('1')\n")
    store = f"--store={tmp_path}/out"

    def call(*args):
        code = cli.main([store, *args])
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    code, (counts,) = call("index", str(src))
    assert code == 0 and counts["files"] == 2 and counts["calls"] == 2 and counts["imports"] == 1
    assert [r["qname"] for r in call("definition", "parse_amount")[1]] == ["util.parse_amount"]
    assert {r["src_name"] for r in call("callers", "parse_amount")[1]} == {"order.OrderService#total", "order.main"}
    assert [r["dst_name"] for r in call("callees", "total")[1]] == ["util.parse_amount"]
    assert [r["depth"] for r in call("impact", "parse_amount")[1]] == [1, 1]
    assert call("search", "where is parse_amount")[1][0]["title"] == "util.parse_amount"
    assert call("definition", "nothing_here") == (1, [])
