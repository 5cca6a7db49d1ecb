import datetime as dt

import pytest
from pyspark.sql import functions as F

from plenum.operators import usage as us


@pytest.mark.parametrize("n, score", [(5, 1.0), (8, 1.0), (0, 0.0), (4, 0.8), (12, 0.5), (20, 0.0)])
def test_count_score(spark, n, score):
    tasks = [(f"t{i}", "2025-01-02", None) for i in range(n)]
    df = spark.createDataFrame([(1, "2025-02-01", tasks, [("T0",)])], "run_id int, election_date string, tasks array<struct<title:string,date:string,url:string>>, expected array<struct<title:string>>")
    r = us.event_list_scores(df, dt.date(2025, 1, 1)).first()
    assert r.count_in_range == pytest.approx(score)
    assert r.title_overlap == pytest.approx(1 / n if n else 0.0) and r.dates_in_range == (1.0 if n else 0.0)


def test_costs(spark):
    df = spark.createDataFrame([("gemini-2.5-pro", 1_000_000, 0, 1_000_000), ("nobody", None, None, 1000)], "model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint")
    for prices in (None, us.price_table(spark)):
        rows = {r.model: r for r in us.usage_cost(df, prices).collect()}
        assert rows["gemini-2.5-pro"].cost == pytest.approx(1.25)
        assert (rows["nobody"].prompt_tokens, rows["nobody"].completion_tokens) == (700, 300)
        assert rows["nobody"].cost == pytest.approx(700 * 0.30e-6 + 300 * 2.5e-6)


def test_static_tasks_give_way(spark):
    schema = "title string, flow_type string, week int, date string"
    g = spark.createDataFrame([("g", "text", 2, "2025-01-01")], schema)
    s = spark.createDataFrame([("s1", "text", 2, None), ("s2", "events", 2, None), ("s3", "text", 1, None)], schema)
    assert [r.title for r in us.merge_tasks(g, s).collect()] == ["s3", "g", "s2"]
    assert us.merge_tasks(g, s, prefer_generated=False).count() == 4


def test_conversation_file(spark, tmp_path):
    from plenum.sources.readers import read_json_lines
    path = tmp_path / "log.jsonl"
    path.write_text('{"type":"assistant","message":{"content":[{"type":"tool_use","name":"Bash","input":{"command":"ls"}},{"type":"text","text":"hi"}]}}\nnot json\n'
                    '{"type":"tool_result","content":"bad\\nthing","is_error":true}\n{"type":"result","total_cost_usd":0.5,"num_turns":3}\n')
    log = read_json_lines(spark, str(path), us.CONVERSATION_SCHEMA)
    assert [(r.tool, r.calls) for r in us.tool_calls(log).collect()] == [("Bash", 1)]
    s = us.conversation_summary(log).first()
    assert (s.assistant_messages, s.errors, s.total_cost, s.turns) == (1, 1, 0.5, 3)
    assert [r.preview for r in us.error_previews(log).collect()] == ["bad thing"]
