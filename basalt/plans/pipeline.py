"""The four verbs end to end: process, augref, generate, evaluate. All stages meet by function key, never by position."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import callgraph, curation, dataflow, denoise, graphs, judge, metrics, prompts, splits
from basalt.plans.providers import Provider, replies
from basalt.sources.shared import kept

MODES = ("M1", "M2", "M3", "M4")


def with_fn_id(df: DataFrame) -> DataFrame:
    return df.withColumn("fn_id", F.concat_ws("/", "project_name", "binary_name", F.col("function_addr").cast("string")))


def process(stripped: DataFrame, unstripped: DataFrame, sources: DataFrame | None, source_order: list[str] = ("file_path",)) -> DataFrame:
    """Curate: match builds and sources, gate, deduplicate, add code features. Without sources everything about them is skipped."""
    merged = with_fn_id(curation.match_stripped(stripped, unstripped))
    if sources is None:
        return merged
    gated = curation.quality_gates(curation.match_source(merged, sources, list(source_order)))
    keyed = gated.withColumn("base_key", T.binary_key(F.col("project_name"), F.col("function_addr"), F.col("strip_function_name"), F.col("strip_decompiled_code")))
    kept = curation.greedy_dedup(keyed, "fn_id", "source_code", "base_key").drop("base_key")
    instructions = kept.select("fn_id", F.explode("cfg").alias("block", "b")).select("fn_id", "block", F.posexplode("b.instructions").alias("pos", "i")).select("fn_id", "block", "pos", F.col("i.disassembly").alias("asm"))
    features = dataflow.code_features(instructions, graphs.edges_of(kept, "fn_id"), "fn_id")
    return kept.join(features.select("fn_id", F.struct("code", "data_dep").alias("codeart")), "fn_id", "left")


def neighbours(dataset: DataFrame) -> DataFrame:
    """Add the code of callees and callers that are in the dataset (same project and binary)."""
    target = F.concat_ws("/", "project_name", "binary_name", F.col("k"))
    edges = lambda c: dataset.select(F.col("fn_id").alias("source_id"), "project_name", "binary_name", F.explode(c).alias("k", "n")).select("source_id", target.alias("target_id"))
    out = callgraph.enrich(dataset, edges("callees"), "fn_id", "codeart", "source_id", "target_id", "callee_code")
    return callgraph.enrich(out, edges("callers"), "fn_id", "codeart", "source_id", "target_id", "caller_code")


def augref(dataset: DataFrame, provider: Provider, order: list[str] = ("fn_id",), store: str | None = None, commits: int = 1) -> DataFrame:
    """Add model-made references: one request for each distinct key, asked again once if the summary is poor. `store` keeps replies, so that a later run asks only what is new."""
    items = curation.collect_references(dataset, "project_name", "source_code", list(order)).select("key", prompts.reference_prompt("source_code").alias("prompt"))
    accept = lambda s, row: not T.bad_summary(s)
    got = replies(items, "prompt", provider, "reference", store, commits=commits, attempts=5, accept=accept, tries=2)
    return curation.apply_reference(dataset, got.select("key", "reference"), "project_name", "source_code")


def test_functions(dataset: DataFrame, limit: int = 200) -> DataFrame:
    """The last tenth in order of function key, of medium length, the first `limit`."""
    test = splits.split_80_10_10(dataset, ["fn_id"]).filter("split = 'test'").drop("split", "split_position")
    return splits.first_rows(test.filter(T.word_gate("strip_decompiled_code")), ["fn_id"], limit)


def path_summaries(functions: DataFrame, provider: Provider, store: str | None = None) -> DataFrame:
    """(fn_id, cfg_summary): representative paths in the order that costs least, repeated blocks shown once, summarised by the provider."""
    paths = graphs.paths(graphs.edges_of(functions, "fn_id"), "fn_id")
    steps = paths.select("fn_id", F.posexplode("path").alias("path", "p")).select("fn_id", "path", F.posexplode("p").alias("pos", "block"))
    texts = kept(functions.select("fn_id", "cfg").join(steps, "fn_id").select("fn_id", "path", "pos", T.block_text("cfg", F.col("block")).alias("content")))
    shown = prompts.in_best_order(texts, "fn_id").select("fn_id", prompts.path_prompt("prompt_blocks").alias("prompt"))
    reply = replies(shown, "prompt", provider, "paths", store)
    return reply.select("fn_id", T.strip_quotes(F.coalesce(F.try_variant_get(T.salvage_json("paths"), "$.global_summary", "string"), F.lit(""))).alias("cfg_summary"))


def _labels_all(reply: str, row: dict) -> bool:
    """Whether a reply's results label every fragment of its row."""
    try:
        found = json.loads(re.search(r"\{.*\}", re.sub(r"(?is)<think>.*?</think>", "", reply), re.S)[0])
        return set(range(int(row["n"]))) <= {r["index"] for r in found["results"] if isinstance(r.get("is_junk"), bool)}
    except (TypeError, ValueError, KeyError, AttributeError):
        return False


def denoised(functions: DataFrame, candidates: DataFrame, provider: Provider, store: str | None = None) -> DataFrame:
    """(fn_id, filter_strong, filter_backup, filter_uncertain) of (fn_id, probed_sources).

    The first stage has to label every fragment: it is asked up to five times, and a function that is still incomplete is an error. The second is
    asked up to three times for a reply in JSON; without one a function has no features, and no match. Replies are written once, and both of the second stage's results come from the same reply.
    """
    clean = candidates.select("fn_id", F.slice(T.clean_snippets("probed_sources"), 1, 5).alias("snippets"))
    code = functions.select("fn_id", F.col("strip_decompiled_code").alias("code"))
    one = clean.select("fn_id", F.size("snippets").alias("n"), prompts.junk_prompt("snippets").alias("prompt"))
    first = replies(one, "prompt", provider, "first", store, carry=["n"], accept=_labels_all, tries=5, required=True).drop("n")
    complete = F.when(F.col("first").isNull(), F.raise_error(F.concat(F.lit("fragments without label: "), F.col("fn_id"))).cast("string")).otherwise(F.col("first"))
    first = first.withColumn("first", complete)
    is_json = lambda s, row: "{" in s and "}" in s
    second = replies(clean.join(code, "fn_id").select("fn_id", prompts.match_prompt("code", "snippets").alias("prompt")), "prompt", provider, "second", store, accept=is_json, tries=3)
    got = lambda c, path, kind: F.coalesce(F.try_variant_get(T.salvage_json(c), path, kind), F.array().cast(kind))
    labels = first.select("fn_id", F.explode_outer(got("first", "$.results", "array<struct<index:int,is_junk:boolean>>")).alias("r")).select("fn_id", F.col("r.index").alias("idx"), F.col("r.is_junk").alias("is_junk")).filter("idx IS NOT NULL").dropDuplicates(["fn_id", "idx"])
    rows = clean.select("fn_id", F.posexplode("snippets").alias("idx", "fragment")).join(labels, ["fn_id", "idx"], "left")
    stage = second.select("fn_id", got("second", "$.extracted_features", "array<string>").alias("features"), got("second", "$.results", "array<struct<index:int,is_source_match:boolean,is_domain_match:boolean>>").alias("results"))
    return denoise.buckets(denoise.denoise(rows, code, stage))


def generate(functions: DataFrame, provider: Provider, mode: str = "M1", candidates: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """(fn_id, generation_mode, generated_summary, reference, source_code) with the context of a mode: M2 adds paths, M3 raw snippets, M4 denoised ones."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    rows, paths, snippets = functions, None, None
    if mode != "M1":
        rows, paths = rows.join(path_summaries(functions, provider, store), "fn_id", "left"), "cfg_summary"
    if mode in ("M3", "M4") and candidates is None:
        raise ValueError(f"mode {mode} needs candidates")
    if mode == "M3":
        rows, snippets = rows.join(candidates.select("fn_id", F.slice(T.clean_snippets("probed_sources"), 1, 5).alias("snippets")), "fn_id", "left"), "snippets"
    if mode == "M4":
        tags = denoised(functions, candidates, provider, store).select("fn_id", T.tagged_snippets("filter_strong", "filter_backup", "filter_uncertain").alias("snippets"))
        rows, snippets = rows.join(tags, "fn_id", "left"), "snippets"
    asked = replies(rows.select("fn_id", "reference", "source_code", prompts.synthesis_prompt("strip_decompiled_code", paths, snippets).alias("prompt")), "prompt", provider, f"summary_{mode}", store)
    return asked.select("fn_id", F.lit(mode).alias("generation_mode"), F.coalesce(T.strip_thinking(f"summary_{mode}"), F.lit("")).alias("generated_summary"), "reference", "source_code")


def evaluate(summaries: DataFrame) -> DataFrame:
    """(fn_id, system, metric, score) for every mode's summaries against their references."""
    pairs = curation.require_fields(summaries, ["reference"]).withColumn("sample", F.concat_ws("|", "generation_mode", "fn_id"))
    scored, errors = metrics.score_all(pairs, "sample", "generated_summary", "reference")
    names = [c for c in scored.columns if c != "sample"]
    long = scored.unpivot("sample", names, "metric", "score")
    return long.select(F.substring_index("sample", "|", -1).alias("fn_id"), F.substring_index("sample", "|", 1).alias("system"), "metric", "score")


def judge_summaries(pivoted: DataFrame, labels: list[str], provider: Provider, store: str | None = None) -> DataFrame:
    """(fn_id, system, accuracy, coverage, effectiveness): three calls a sample however many systems there are. pivoted: fn_id, source_code and generated_summary_<label> columns.

    Scores are expectations over the alternatives of the reply's score tokens if the provider gives them and there are three for each label, in the labels' order; else those that the reply states.
    """
    texts = F.concat_ws("\n", *(F.concat(F.lit(f"{x}: "), T.text(f"generated_summary_{x}")) for x in labels))
    one = replies(pivoted.select("fn_id", texts.alias("summaries"), prompts.semantics_prompt("source_code").alias("prompt")), "prompt", provider, "semantics", store).drop("semantics_error")
    two = replies(one.withColumn("prompt", prompts.claims_prompt("semantics", "summaries")), "prompt", provider, "claims", store).select("fn_id", prompts.scores_prompt("claims").alias("prompt"))
    three = replies(two, "prompt", provider, "scores", store, logprobs=True)
    weighted = judge.weighted_scores(F.from_json("scores_tokens", judge.TOKENS), len(labels))
    stated = lambda x: judge.scores_from_reply("scores", x)
    each = F.array(*(F.struct(F.lit(x).alias("system"), *(F.coalesce(judge.normalise(F.get("weighted", F.lit(3 * k + j))), c).alias(name) for j, (name, c) in enumerate(zip(judge.CRITERIA, stated(x), strict=True)))) for k, x in enumerate(labels)))
    return three.withColumn("weighted", weighted).select("fn_id", F.inline(each))
