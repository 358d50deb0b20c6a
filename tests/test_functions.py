"""Expressions, the instruction model and C extraction against plain restatements."""

import random
import re

import pytest
from pyspark.sql import functions as F

from basalt.functions import asm, c_source
from basalt.functions import text as T
from basalt.sources.config import Options, typed


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first().x


def effects_of(spark, code, strict=False):
    return spark.createDataFrame([(code,)], "code string").select(asm.effects(F.col("code"), strict).alias("e")).first().e


@pytest.mark.parametrize("s", ["", "a", "int f(a){return a;}", "é_1 ñ ß!", "a b", "x  y\n", "漢字 ok", "١٢"])
def test_counts(spark, s):
    assert one(spark, T.token_count("s"), s=s) == len(re.findall(r"\w+|[^\s\w]", s))
    assert one(spark, T.word_count("s"), s=s) == len(s.split())


def test_null_counts(spark):
    row = spark.createDataFrame([(None,)], "s string").select(T.token_count("s").alias("a"), T.word_count("s").alias("b"), T.is_bad_summary("s").alias("c")).first()
    assert tuple(row) == (0, 0, True)


def test_keys_and_snippets(spark):
    assert one(spark, T.project_of("s"), s="zlib-1.2-x") == "zlib"
    assert one(spark, T.reference_key("p", "s"), p="p", s="é" * 30) == "p::" + "é" * 20
    assert one(spark, T.clean_snippet("s"), s="a<asm_token>\nx<asm_token>\n <b>int</b> f(); ") == "int f();"
    assert one(spark, T.strip_thinking("s"), s="<think>a\nb</THINK> yes ") == "yes"
    assert one(spark, T.first_sentence("s"), s=" Adds  two. More") == "Adds two"
    assert one(spark, T.signature("s"), s="int f(int a) { return 1; }") == "int f(int a) "
    assert one(spark, T.strip_quotes("s"), s=' "ok" ') == "ok"


@pytest.mark.parametrize("s,bad", [("Adds two numbers", False), ("This function adds", True), ("performs work", True), ("performs the sum of two big numbers", False), (" ".join("w" * 31), True), ("  ", True)])
def test_bad_summaries(spark, s, bad):
    assert one(spark, T.is_bad_summary("s"), s=s) is bad


@pytest.mark.parametrize("s,want", [("10", 1.0), ("1", 0.0), ("5", 0.4444), ("x", 0.0), ("7.5", 0.7222)])
def test_scores(spark, s, want):
    assert one(spark, T.normalised_score("s"), s=s) == want


@pytest.mark.parametrize("s,want", [('{"a": 1}', 1), ('Sure: {"a": 2} ok', 2), ('<think>{"a": 9}</think>{"a": 3}', 3), ("garbage {", None), ("", None)])
def test_json_salvage(spark, s, want):
    assert one(spark, F.try_variant_get(T.salvage_json("s"), "$.a", "int"), s=s) == want


def test_block_maps(spark):
    from basalt.sources.schemas import BLOCK

    ins = lambda *d: [{"address": 0, "mnemonic": "", "disassembly": x} for x in d]
    block = lambda succ, *d: {"start_ea": 0, "end_ea": 0, "instructions": ins(*d), "successors": succ, "predecessors": []}
    df = spark.createDataFrame([({20: block([], "c"), 10: block([20], "a", "", "b")}, {}, {"x": 1})], f"cfg map<bigint,{BLOCK}>, callees map<string,bigint>, callers map<string,bigint>")
    row = df.select(T.flat_asm("cfg").alias("a"), T.block_text("cfg", F.lit(10).cast("long")).alias("b"), T.block_text("cfg", F.lit(9).cast("long")).alias("c"), T.has_edges("cfg").alias("d"), T.connected("callees", "callers").alias("e")).first()
    assert row.a == ["a", "", "b", "c"] and row.b == "a\nb" and row.c == "" and row.d and row.e


@pytest.mark.parametrize(
    "code,defs,uses",
    [
        ("mov eax, [rbp+var_4]", {"rax"}, {"[rbp+4]"}),
        ("mov [rcx+8], eax", {"[rcx+8]", "GLOBAL"}, {"rcx", "rax"}),
        ("test eax, eax", {"EFLAGS", "rax"}, {"rax"}),
        ("jz loc_1", set(), {"EFLAGS", "CONST"}),
        ("push rbx", {"stack_rbx"}, {"rbx"}),
        ("pop rbx", {"rbx"}, {"stack_rbx"}),
        ("call foo", {"rax"}, {"foo"}),
        ("retn", set(), {"rax"}),
        ("xor eax, eax", {"rax", "EFLAGS"}, set()),
        ("lea rdi, sub_4010", {"rdi"}, {"CONST", "rdi"}),
        ("add r8d, 10h ; note", {"r8", "EFLAGS"}, {"r8", "CONST"}),
        ("cmp dword ptr [rax], 5", {"EFLAGS"}, {"rax", "[rax]", "GLOBAL", "CONST"}),
        ("setz al", {"rax"}, {"EFLAGS", "rax"}),
        ("nop", set(), set()),
    ],
)
def test_effects(spark, code, defs, uses):
    e = effects_of(spark, code)
    assert set(e.defs) == defs and set(e.uses) == uses


def test_registers_follow_their_names(spark):
    made = {f"{p}{r}{s}" for p in ("", "e", "r") for r in (*"abcd", "si", "di", "bp", "sp", *map(str, range(18))) for s in ("", "l", "h", "x", "b", "w", "d")}
    rows = spark.createDataFrame([(x,) for x in sorted(made)], "x string").filter(asm.is_register(F.col("x")))
    whole = {r.x: r.form for r in rows.select("x", asm.operand_form(F.lit("mov"), F.lit(1), F.col("x")).alias("form")).collect()}
    assert len(whole) == 68 and whole["sil"] == "rsi" and whole["r15w"] == "r15" and len(set(whole.values())) == 16
    assert effects_of(spark, "test eax, eax", True).defs == ["EFLAGS"]


def test_code_without_operands(spark):
    """Null and empty code define and use nothing; an operand that is missing counts as an empty name."""
    assert tuple(effects_of(spark, None)) == ("", [], []) and tuple(effects_of(spark, "")) == ("", [], [])
    assert tuple(effects_of(spark, "push")) == ("push", ["stack_"], [""]) and effects_of(spark, "mov eax,").uses == [""]


def test_c_functions():
    text = "/* Adds. */\n\nint add(int a) {\n if (a) { return 1; }\n return 2; }\n// one\n// two @x\nstatic void g(void) { }\nint open_(int a) { if (a) {\n"
    assert list(c_source.functions(text)) == [("add", "int add(int a) {\n if (a) { return 1; }\n return 2; }", "Adds"), ("g", "static void g(void) { }", "one two")]


def test_balanced_counts_braces():
    r = random.Random(1)
    for _ in range(200):
        s = "".join(r.choice("{}ab") for _ in range(12))
        depth, want = 0, ""
        for k, c in enumerate(s):
            depth += (c == "{") - (c == "}")
            if c in "{}" and depth == 0:
                want = s[: k + 1]
                break
        assert c_source.balanced(s, 0) == want


def test_options():
    o = Options.parse("[gpt]\nmodel = a\n[generation_synthesis]\ntemperature = 0.5\nmax_tokens = 10\n")
    assert o.generation("synthesis") == {"temperature": 0.5, "max_tokens": 10} and typed("x") == "x"
    assert o.provider("gpt", {"MODEL": "b"})["model"] == "b"
    with pytest.raises(KeyError):
        o.provider("default", {})


def test_literals_are_read_until_they_are_no_strings():
    from basalt.functions import reprs

    nested = repr(repr({"a": [1, (2, None)], "b": "x"}))
    assert reprs._literal(nested) == '{"a": [1, [2, null]], "b": "x"}'
    assert reprs._literal("no literal") is None and reprs._literal(None) is None and reprs._literal("'just text'") == '"just text"' and reprs._literal("12") == "12"
