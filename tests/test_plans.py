"""The four verbs with a stub provider, streaming resume, and the registered queries' SQL."""

import os

import pytest
from pyspark.sql import functions as F

from basalt.plans import pipeline
from basalt.plans.providers import StubProvider, ask, with_retry
from basalt.plans import code_queries, model_queries, queries, record_queries  # noqa: F401  they register queries
from basalt.plans.registry import ORACLE_SQL, QUERIES
from basalt.sources import readers
from basalt.sources.schemas import BLOCK
from basalt.streaming.resume import answer_stream

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dataset(spark):
    block = lambda succ, *d: {"start_ea": 0, "end_ea": 0, "instructions": [{"address": 0, "mnemonic": "", "disassembly": x} for x in d], "successors": succ, "predecessors": []}
    cfg = {1: block([2, 3], "mov eax, 1", "jz loc_2"), 2: block([3], "add eax, 5"), 3: block([], "retn")}
    code = "int f ( int a ) { " + " ".join(f"x{k} = a + {k} ;" for k in range(40)) + " }"
    stripped = [("p-1", "b", k, f"sub_{k}", code + str(k % 5), cfg, {str((k + 1) % 12): 1}, {}) for k in range(12)]
    schema = f"project_name string, binary_name string, function_addr long, function_name string, decompiled_code string, cfg map<bigint,{BLOCK}>, callees map<string,bigint>, callers map<string,bigint>"
    s = spark.createDataFrame(stripped, schema)
    u = s.select("project_name", "binary_name", "function_addr", F.concat(F.lit("fn"), F.col("function_addr")).alias("function_name"), "decompiled_code")
    src = spark.createDataFrame([("p-2", "a.c", f"fn{k}", code + f" /* {min(k, 9)} */", "Adds") for k in range(12)], "project_name string, file_path string, function_name string, source_code string, comment string")
    return pipeline.process(s, u, src).persist()


def test_process(dataset):
    rows = dataset.collect()
    assert len(rows) == 10 and {r.function_addr for r in rows} == {*range(9), 10}  # the first of equal sources by key
    assert [i.asm for i in rows[0].codeart.code] == ["mov eax, 1", "jz loc_2", "add eax, 5", "retn"]
    assert {(d.use_id, d.def_id) for d in rows[0].codeart.data_dep} == {(2, 0), (3, 0), (3, 2)}


def test_neighbours_and_training(dataset):
    from basalt.operators import training

    near = pipeline.neighbours(dataset)
    assert {r.function_addr: len(r.callee_code) for r in near.collect()} == {k: int(k < 8) for k in [*range(9), 10]}
    rows = training.signature_set(near).collect()
    assert len(rows) == 10 and all("{" not in r.src for r in rows) and training.probing_set(near).count() == 1


def test_augref_generate_evaluate(spark, dataset):
    with_ref = pipeline.augref(dataset, StubProvider()).persist()
    assert with_ref.filter("reference IS NULL").count() == 0
    cands = dataset.select("fn_id", F.array(F.lit("x<asm_token>\nint g();"), F.lit(" ")).alias("probed_sources"))
    for mode in pipeline.MODES:
        out = pipeline.generate(with_ref, StubProvider(), mode, cands).persist()
        assert out.count() == 10 and out.filter("generated_summary = ''").count() == 0
    scores = pipeline.evaluate(out).collect()
    assert {r.metric for r in scores} == {"bleu_1", "bleu_2", "bleu_3", "bleu_4", "rouge_l", "meteor_approx"} and len(scores) == 60
    with pytest.raises(ValueError):
        pipeline.generate(with_ref, StubProvider(), "M3")
    judged = pipeline.judge_summaries(out.withColumn("generated_summary_A", F.col("generated_summary")), ["A"], lambda p: '{"A": {"accuracy": 10, "coverage": 1}}').collect()
    assert all((r.accuracy, r.coverage, r.effectiveness) == (1.0, 0.0, None) for r in judged)


def counting(folder, rule):
    """A provider that notes each call in a folder and answers by a rule, and the number of calls so far."""
    folder = str(folder)
    os.mkdir(folder)

    def provider(prompt):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return rule(prompt)

    return provider, lambda: len(os.listdir(folder))


def test_a_prompt_is_asked_once_and_a_second_run_asks_nothing(spark, dataset, tmp_path):
    provider, calls = counting(tmp_path / "calls", StubProvider())
    cands = dataset.select("fn_id", F.array(F.lit("x<asm_token>\nint g();"), F.lit("int h();")).alias("probed_sources"))
    with_ref = pipeline.augref(dataset, provider, store=str(tmp_path / "s"), commits=3)
    assert with_ref.count() == 10 and with_ref.count() == 10
    keys = dataset.select(F.concat("project_name", F.substring("source_code", 1, 20))).distinct().count()
    assert calls() == keys
    out = pipeline.denoised(with_ref, cands, provider, str(tmp_path / "s"))
    assert out.count() == 10 and all(len(r.filter_uncertain) == 2 for r in out.collect())
    codes = dataset.select("strip_decompiled_code").distinct().count()
    assert calls() == keys + 1 + codes  # all functions have the same fragments
    pipeline.augref(dataset, provider, store=str(tmp_path / "s")).collect()
    pipeline.denoised(with_ref, cands, provider, str(tmp_path / "s")).collect()
    assert calls() == keys + 1 + codes


def test_every_fragment_needs_a_label(spark, dataset, tmp_path):
    provider, calls = counting(tmp_path / "calls", lambda p: '<think>{}</think>{"results": [{"index": 0, "is_junk": true}]}')
    one, two = (dataset.select("fn_id", F.array(*map(F.lit, names)).alias("probed_sources")) for names in (["int g();"], ["int g();", "int h();"]))
    assert pipeline.denoised(dataset, one, provider).count() == 10
    before = calls()
    with pytest.raises(Exception, match="fragments without label"):
        pipeline.denoised(dataset, two, provider).collect()
    assert calls() - before >= 5


def test_judge_takes_expected_scores(spark):
    class Scored:
        def __call__(self, prompt):
            return '{"A": {"accuracy": 1, "coverage": 1, "effectiveness": 1}}'

        def with_logprobs(self, prompt):
            alternatives = lambda *xs: [{"token": t, "logprob": p} for t, p in xs]
            digits = [alternatives(("7", -0.5), ("9", -0.5)), alternatives(("10", -0.1)), alternatives(("3", 0.0), ("x", 0.0))]
            return self(prompt), [{"token": "{", "top_logprobs": []}, *({"token": a[0]["token"], "top_logprobs": a} for a in digits)]

    row = spark.createDataFrame([("f", "int f;", "does")], "fn_id string, source_code string, generated_summary_A string")
    got = pipeline.judge_summaries(row, ["A"], Scored()).first()
    assert (got.system, got.accuracy, got.coverage, got.effectiveness) == ("A", 0.7778, 1.0, 0.2222)


def test_failures_are_rows(spark):
    def broken(prompt):
        raise OSError("down")

    row = ask(spark.createDataFrame([("p",)], "prompt string"), "prompt", broken, attempts=2, delay=0).first()
    assert row.reply is None and row.reply_error == "OSError: down"
    waits = []
    assert with_retry(lambda: 1 / 0, 3, 2.0, waits.append)[1].startswith("ZeroDivisionError") and waits == [2.0, 4.0]


def test_stream_resumes(spark, tmp_path):
    items, table = str(tmp_path / "items"), str(tmp_path / "table")
    run = lambda: answer_stream(spark, items, "key string, prompt string", table, str(tmp_path / "c"), StubProvider()).awaitTermination()
    rows = lambda *ks: spark.createDataFrame([(k, f"p{k}") for k in ks], "key string, prompt string").coalesce(1).write.mode("append").parquet(items)
    rows("a", "b")
    run()
    rows("b", "c")
    run()
    assert sorted(r.key for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]


def test_readers(spark, tmp_path):
    os.makedirs(tmp_path / "src/proj/sub")
    (tmp_path / "src/proj/sub/a.c").write_text("int f(void) { return 1; }")
    (tmp_path / "src/proj/b.h").write_text("int g(void) { return 1; }")
    got = readers.c_functions(readers.c_files(spark, str(tmp_path / "src"))).collect()
    assert [(r.project_name, r.file_path, r.function_name) for r in got] == [("proj", "proj/sub/a.c", "f")]
    os.makedirs(tmp_path / "bin/proj")
    (tmp_path / "bin/proj/x.json").write_text('{"16": {"function_name": "sub_10", "start_ea": 16, "decompiled_code": "c", "cfg": {"16": {"start_ea": 16, "instructions": [], "successors": []}}, "callees": {"32": 2}}}')
    row = readers.disassembly(spark, str(tmp_path / "bin")).first()
    assert (row.project_name, row.binary_name, row.function_addr, row.callees) == ("proj", "x", 16, {"32": 2}) and list(row.cfg) == [16]
    import pyarrow as pa

    rows = pa.table({"a": [1, 2], "b": ["x", None]})
    with pa.OSFile(str(tmp_path / "data.arrow"), "wb") as sink, pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    assert [tuple(r) for r in readers.arrow_files(spark, str(tmp_path), "a long, b string").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "src/proj/sub/two.c").write_text("int f2(void) {\n return 1;\n}\n// Adds. More\nint f3(int a) {\n return a; }")
    got = readers.c_functions(readers.c_files(spark, str(tmp_path / "src"))).filter("file_path LIKE '%two.c'").collect()
    assert [(r.function_name, r.comment) for r in got] == [("f2", None), ("f3", "Adds")]
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "r.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.records(spark, str(tmp_path / "r.jsonl")).count() == readers.records(spark, str(tmp_path / "r.json")).count() == 2


def canon(rows, columns):
    value = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(str(value(r[columns.index(c)])) for c in sorted(columns)) for r in rows))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{t}')")
    df, want = QUERIES[name](spark, SMALL), con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(want.fetchall(), want.columns)


def test_harvest_gate_counts_tokens_as_its_sql(spark, tmp_path):
    import duckdb

    words = lambda n: " ".join(["word"] * n)
    texts = [words(18), words(19), words(14) + " {;}/", words(15) + " {;}/", "/* {" + words(10) + "} */ //", None, words(9179), words(9180), ";" * 19, "x}"]
    rows = [(k * 35 + 2, t) for k, t in enumerate(texts)] + [(k * 35 + 5, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.sql(ORACLE_SQL["harvest_gate"]).fetchall())
    assert want == [(k * 35 + 2,) for k in (1, 3, 6, 8)]
    assert sorted(tuple(r) for r in QUERIES["harvest_gate"](spark, str(tmp_path)).collect()) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 100
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_http_provider(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from basalt.plans.providers import HttpProvider

    asked = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers["Authorization"], body))
            prompt = body["messages"][0]["content"]
            if prompt == "fails":
                self.send_error(500)
                return
            choice = {"message": {"content": f"reply to {prompt}"}}
            if body.get("logprobs"):
                choice["logprobs"] = {"content": [{"token": "7", "top_logprobs": [{"token": "7", "logprob": -0.1}, {"token": "8", "logprob": -2.5}]}]}
            data = json.dumps({"choices": [choice]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        provider = HttpProvider(f"http://127.0.0.1:{server.server_port}/v1/", "some-model", "key", max_tokens=9)
        df = spark.createDataFrame([(1, "one"), (2, "fails"), (3, "three")], "k int, prompt string")
        got = {r.k: (r.reply, r.reply_error) for r in ask(df, "prompt", provider, attempts=2, delay=0.01).collect()}
        assert got[1] == ("reply to one", None) and got[3][0] == "reply to three" and got[2][0] is None and "500" in got[2][1]
        assert provider.with_logprobs("x") == ("reply to x", [{"token": "7", "top_logprobs": [{"token": "7", "logprob": -0.1}, {"token": "8", "logprob": -2.5}]}])
    finally:
        server.shutdown()
    assert sum(b["messages"][0]["content"] == "fails" for _, _, b in asked) == 2
    path, authorization, body = asked[0]
    assert path == "/v1/chat/completions" and authorization == "Bearer key" and body["model"] == "some-model" and body["max_tokens"] == 9
