import json

import duckdb
import pytest

from tamis.llm import toolcalls
from tamis.llm.toolcalls import Field

SCHEMAS = {"f": {"a": Field("bigint", most=9), "b": Field("string", False, least=2)}, "g": {}, "h": {"x": Field("double"), "y": Field("boolean")}}
CALL = "conv_id long, id string, name string, arguments map<string,string>, after array<string>"


def linked(spark, calls, results):
    c = spark.createDataFrame(calls, CALL).selectExpr("*", "1 as content", "2 as level", "'x' as status", "3 as n_results", "4 as top")
    r = spark.createDataFrame(results, "conv_id long, id string, content string").selectExpr("*", "1 as level", "'x' as name", "5 as after")
    return toolcalls.link_tool_calls(c, r, SCHEMAS)


def against_sql(spark, conversations):
    db = duckdb.connect()
    db.register("conversations", conversations.toArrow())
    calls, results = toolcalls.chat_calls(conversations)
    found = toolcalls.link_tool_calls(calls, results, toolcalls.CHAT_SCHEMAS)
    got = db.execute(toolcalls.OP8_SQL)
    names = [d[0] for d in got.description]
    rows = [(*r[:6], ",".join(r[6]), ",".join(r[7]), *r[8:]) for r in map(tuple, found.select(*names).collect())]
    assert sorted(map(str, rows)) == sorted(map(str, got.fetchall()))
    return found.collect()


def test_table_and_sql(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = against_sql(spark, table)
    assert toolcalls.op8_tool_call_linking(spark, sf_dir).count() == len(rows) > 0
    assert any(r.errors for r in rows) and any(r.unmet for r in rows) and any(r.valid for r in rows)
    for r in rows:
        x = json.loads(r.json)
        assert r.json == json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        assert r.name is None or isinstance(x["arguments"]["n_words"], int)


def test_odd_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of one") for t in range(9)] + [(1, 4, "user", "once more at four"), (1, 4, "user", "once more at four")]
    rows += [(2, 0, "assistant", "first"), (2, 1, "assistant", None), (2, 2, "user", None), (2, 7, "user", "w " * 5000), (3, 0, "tool", "who"), (3, 1, None, "x"), (None, 1, "user", "a b c"), (None, 2, "assistant", "y"), (4, None, "user", "a b c"), (4, None, "assistant", "z")]
    found = against_sql(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as id", "'q' as after"))
    level = {(r.conv_id, r.id): r.level for r in found if r.status != "unmatched"}
    assert [level[1, str(t)] for t in (0, 2, 4, 6, 8)] == [0, 1, 2, 3, 4] and level[None, "1"] is None and level[4, None] is None
    assert sum(r.conv_id == 1 and r.id == "4" for r in found) == 3
    assert {(r.conv_id, r.id) for r in found if r.status == "unmatched"} == {(2, "-1"), (2, "0"), (3, "-1"), (3, "0"), (None, "1"), (4, None)}


def test_order_links_and_validation(spark):
    calls = [
        (1, "a", "f", {"b": 'q"é\n', "a": "1"}, []),
        (1, "b", "f", {"a": "x"}, ["a"]),
        (1, "c", "g", {"z": "1"}, ["a", "b", "gone"]),
        (1, "d", "nobody", None, None),
        (1, "e", "g", {}, ["f"]),
        (1, "f", "g", {}, ["e"]),
        (1, "g", "g", {}, ["f", None]),
        (1, "h", "h", {"x": "1.5", "y": "true"}, ["c", "i", "c"]),
        (1, "i", "f", {"a": "10", "b": "q"}, ["c"]),
        (1, "j", "g", {}, ["h"]),
        (1, "k", "g", {}, ["j", "g"]),
        (2, "a", "f", {"a": None}, ["a"]),
        (None, None, None, {}, ["a"]),
        (None, "a", "g", {}, []),
        (3, "twice", "g", {}, []),
        (3, "twice", "g", {}, []),
    ]
    results = [(1, "a", "two"), (1, "a", "one"), (1, "b", "r"), (None, None, "lost"), (3, "twice", None), (9, "a", "other"), (None, "a", "never")]
    got = {}
    for r in linked(spark, calls, results).collect():
        got.setdefault((r.conv_id, r.id, r.name is not None or r.status != "unmatched"), []).append(r)
    one = {k[:2]: v[0] for k, v in got.items() if k[2]}
    want = {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None, "g": None, "h": 4, "i": 3, "j": 5, "k": None}
    assert {k: r.level for k, r in one.items()} == {(1, k): v for k, v in want.items()} | {(2, "a"): None, (None, None): None, (None, "a"): None, (3, "twice"): 0}
    assert one[1, "a"].json == '{"after":[],"arguments":{"a":1,"b":"q\\"é\\n"},"id":"a","level":0,"name":"f","result":"one"}'
    assert (one[1, "a"].valid, one[1, "a"].n_results, one[1, "a"].status) == (True, 2, "linked")
    assert one[1, "b"].errors == ["type:a"] and one[1, "d"].errors == ["unknown tool"] and one[2, "a"].errors == ["missing:a"]
    assert one[1, "c"].errors == ["unknown:z"] and one[1, "c"].unmet == ["gone"] and one[1, "h"].unmet == ["c", "i"]
    assert one[1, "i"].errors == ["range:a", "range:b"] and '"x":1.5,"y":true' in one[1, "h"].json and '"a":"x"' in one[1, "b"].json
    assert len(got[3, "twice", True]) == 2 and one[3, "twice"].n_results == 1
    assert {k for k in got if not k[2]} == {(None, None, False), (9, "a", False), (None, "a", False)}
    assert linked(spark, [], []).collect() == [] and [r.status for r in linked(spark, [], results[:1]).collect()] == ["unmatched"]


@pytest.mark.parametrize("n", [1000])
def test_long_chain_takes_few_rounds(spark, n, monkeypatch):
    tables = []
    monkeypatch.setattr(toolcalls, "written", lambda df, label, real=toolcalls.written: tables.append(label) or real(df, label))
    calls = [(1, str(i), "g", {}, [str(i - 1)] if i else []) for i in range(n)] + [(2, str(i), "g", {}, [str((i + 1) % 50)]) for i in range(50)]
    got = {(r.conv_id, int(r.id)): r.level for r in toolcalls.levels(spark.createDataFrame(calls, CALL)).collect()}
    assert got == {(1, i): i for i in range(n)} | {(2, i): None for i in range(50)}
    assert len(tables) < 16


def test_main_path_is_native(spark, sf_dir):
    plan = toolcalls.op8_tool_call_linking(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
