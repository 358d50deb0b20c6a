"""Registered queries over records: sources and sinks, projections, gates, metrics, vectors, training sets and model verbs, with their SQL.

Files are written below the shared folder and read again. Model verbs run with providers that answer by a hash of the prompt, which SQL knows, too.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import reprs
from basalt.functions import text as T
from basalt.operators import callgraph, curation, denoise, judge, metrics, splits, training, vectors
from basalt.plans import pipeline
from basalt.plans.queries import _BLEU_BASE, _G, _NORM, _PAIRS, _bleu_select, _keys, _pairs
from basalt.plans.registry import query, table
from basalt.sources import readers, sinks
from basalt.sources.config import Options
from basalt.sources.schemas import BLOCK
from basalt.sources.shared import scratch_folder

# Sources and sinks


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def split_sinks(spark, d):
    """SK1, ST1: a table by architecture, and the union of all its parts."""
    path = f"{scratch_folder(spark)}/dataset"
    sinks.write_table(table(spark, d, "documents").select("doc_id", "source", "n_chars", F.col("lang").alias("arch")), path)
    return spark.read.parquet(path).select("doc_id", F.col("arch").alias("lang"), "source", "n_chars")


@query("SELECT item_id, text FROM benchmark UNION ALL SELECT doc_id, source FROM documents")
def json_tables(spark, d):
    """SK2, SC17: a JSON array and JSON lines, written and read by extension."""
    folder = scratch_folder(spark)
    sinks.write_json_array(table(spark, d, "benchmark"), f"{folder}/a.json")
    sinks.write_json(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("text")), f"{folder}/b.jsonl")
    schema = "item_id long, text string"
    return readers.records(spark, f"{folder}/a.json", schema).unionByName(readers.records(spark, f"{folder}/b.jsonl", schema))


@query("SELECT doc_id, n_chars FROM documents")
def resumed_append(spark, d):
    """SK3, SK5: a table that is filled in two runs, the second with several commits, each only with what is missing."""
    path = f"{scratch_folder(spark)}/table"
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    sinks.append_missing(docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"), path, "doc_id", lambda todo: todo)
    sinks.append_missing(docs, path, "doc_id", lambda todo: todo, commits=3)
    return spark.read.parquet(path)


@query("SELECT d.doc_id, l.quality AS reference FROM documents d LEFT JOIN labels l USING (doc_id)")
def versioned_rewrite(spark, d):
    """SK4: an enriched table is a new version beside the old one."""
    root = scratch_folder(spark)
    first = sinks.next_version(table(spark, d, "documents").select("doc_id"), root, 1)
    second = sinks.next_version(spark.read.parquet(first).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("reference")), "doc_id", "left"), root, 2)
    return spark.read.parquet(second)


@query(f"{_NORM} SELECT vec_id AS key, len(embedding)::BIGINT AS dims, round(embedding[1], 6) AS first, round(list_dot_product(embedding, embedding), 6) AS norm FROM u")
def saved_index(spark, d):
    """SK6, SC18, VC2: keys with unit vectors, saved and loaded."""
    path = f"{scratch_folder(spark)}/keys"
    sinks.write_table(_keys(spark, d), path)
    keys = readers.vectors(spark, path)
    return keys.select("key", F.size("embedding").cast("long").alias("dims"), F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(T.dot("embedding", "embedding"), 6).alias("norm"))


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, (r // ((n + 6) // 7))::INT AS shard, r::BIGINT + 1 AS merged_position FROM n")
def sharded_table(spark, d):
    """SK8, WN13, ST8: contiguous shards, written each, merged in order of shard and place."""
    path = f"{scratch_folder(spark)}/shards"
    placed = splits.positions(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    sinks.write_table(sinks.shards(placed, 7, "position"), path, "shard")
    return splits.positions(spark.read.parquet(path), ["shard", "position"], "merged_position").select("doc_id", "shard", "merged_position")


@query("SELECT lang AS arch FROM (SELECT DISTINCT 'x_' || lang AS lang FROM documents WHERE lang IS NOT NULL)")
def architectures(spark, d):
    """SC15, WN10: names with an underscore, in order."""
    docs = table(spark, d, "documents")
    return readers.architectures(docs.select(F.concat(F.lit("x_"), "lang").alias("arch")).unionByName(docs.select(F.col("source").alias("arch"))))


@query("SELECT DISTINCT lang AS project_name, source AS binary_name FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND lang IS NOT NULL AND source IS NOT NULL")
def binary_pairs(spark, d):
    """SC14: binaries that both exports have."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("project_name"), F.col("source").alias("binary_name"))
    return readers.binary_pairs(docs, docs.join(table(spark, d, "labels"), "doc_id", "left_semi"))


@query("SELECT 'nation_' || n_nationkey AS section, n_nationkey::VARCHAR AS plain, (n_regionkey + 0.5)::VARCHAR AS share, n_name AS label, 'int' AS plain_type, 'float' AS share_type, 'str' AS label_type FROM nation")
def config_values(spark, d):
    """SC20, SF21: typed values of INI text, and the same rule over columns."""
    nations = table(spark, d, "nation").collect()  # the 25 rows of a fixed table
    options = Options.parse("\n".join(f"[nation_{n.n_nationkey}]\nplain = {n.n_nationkey}\nshare = {n.n_regionkey + 0.5}\nlabel = {n.n_name}" for n in nations))
    kinds = {int: "int", float: "float", str: "str"}
    rows = [(s, str(v["plain"]), str(v["share"]), v["label"], *(kinds[type(v[k])] for k in ("plain", "share", "label"))) for s, v in options.sections.items()]
    out = spark.createDataFrame(rows, "section string, plain string, share string, label string, a string, b string, c string")
    same = lambda c, kind: F.when(T.typed(c) == F.col(kind), F.col(kind)).alias(f"{c}_type")
    return out.select("section", "plain", "share", "label", same("plain", "a"), same("share", "b"), same("label", "c"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def python_reprs(spark, d):
    """SF19, PJ17: records to Python's notation, twice nested, and back."""
    docs = table(spark, d, "documents").select("doc_id", F.to_json(F.struct("lang", "source", "n_chars"), {"ignoreNullFields": "false"}).alias("j"))
    twice = docs.select("doc_id", reprs.to_repr(F.to_json(F.create_map(F.lit("r"), reprs.to_repr("j")))).alias("text"))
    back = twice.select("doc_id", reprs.from_repr(F.get_json_object(reprs.from_repr("text"), "$.r")).alias("j"))
    return back.select("doc_id", *(F.get_json_object("j", f"$.{c}").alias(c) for c in ("lang", "source")), F.get_json_object("j", "$.n_chars").cast("long").alias("n_chars"))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def arrow_tables(spark, d):
    """SC18: Arrow streams, a row of bytes for each batch, read back."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")

    def run(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["content"])

    return readers.arrow_records(docs.mapInArrow(run, "content binary"), "doc_id long, text string, lang string, source string, n_chars long")


# Projections and gates

def _functions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as matched functions: project, address, names, code, source; a graph with an edge for three of four; callers for two of three."""
    block = lambda succ: F.from_json(F.lit(json.dumps({"successors": succ})), BLOCK)
    graph = F.when(F.col("doc_id") % 4 > 0, F.create_map(F.lit(1).cast("long"), block([2]), F.lit(2).cast("long"), block([]))).otherwise(F.create_map(F.lit(1).cast("long"), block([])))
    calls = F.when(F.col("doc_id") % 3 > 0, F.create_map(F.lit("7"), F.col("doc_id"), F.lit("8"), F.lit(2).cast("long"))).otherwise(F.from_json(F.lit("{}"), "map<string,bigint>"))
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("source").alias("project_name"), F.col("doc_id").alias("function_addr"), F.concat(F.lit("sub_"), F.col("doc_id").cast("string")).alias("strip_function_name"), F.col("text").alias("strip_decompiled_code"),
        F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("source_code"), F.col("lang").alias("comment"), graph.alias("cfg"), F.lit(None).cast("string").alias("codeart"), calls.alias("callers"), F.from_json(F.lit("{}"), "map<string,bigint>").alias("callees"), F.col("lang").alias("decompiled_code"),
    )


@query("SELECT doc_id AS function_addr, source AS project_name, lang AS comment, CASE WHEN doc_id % 3 > 0 THEN doc_id + 2 ELSE 0 END AS callers_call_count, 0::BIGINT AS callees_call_count FROM documents")
def dataset_projection(spark, d):
    """PJ3: the dataset's columns, with counts of calls."""
    out = curation.dataset_columns(_functions(spark, d))
    return out.select("function_addr", "project_name", "comment", "callers_call_count", "callees_call_count")


@query("SELECT doc_id AS function_addr, 'sub_' || doc_id AS function_name_in_strip, CASE WHEN doc_id % 5 > 0 THEN md5(text) END AS function_body, md5(text) AS pseudo_code, lang AS pseudo_code_non_strip, md5(text) AS pseudo_code_refined, source AS meta FROM documents")
def baseline_projection(spark, d):
    """PJ2: names that baseline systems expect."""
    out = curation.baseline_columns(_functions(spark, d))
    return out.select("function_addr", "function_name_in_strip", F.md5("function_body").alias("function_body"), F.md5("pseudo_code").alias("pseudo_code"), "pseudo_code_non_strip", F.md5("pseudo_code_refined").alias("pseudo_code_refined"), "meta")


_TOK = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}\p{M}\p{Pc}]+|[^\s\p{L}\p{N}\p{M}\p{Pc}]'))"


@query(f"SELECT doc_id AS function_addr, required FROM documents, (VALUES (true), (false)) t(required) WHERE {_TOK} > 30 AND {_TOK} < 9192 AND doc_id % 4 > 0 AND doc_id % 3 > 0 AND (doc_id % 5 > 0 OR NOT required)")
def quality_gates(spark, d):
    """FL1-FL5: bounds, edges, connections, and a source where it is required."""
    fns = _functions(spark, d)
    gated = lambda required: curation.quality_gates(fns, required).select("function_addr", F.lit(required).alias("required"))
    return gated(True).unionByName(gated(False))


@query("SELECT doc_id, trim(source) AS source FROM documents WHERE trim(coalesce(source, '')) <> '' AND text IS NOT NULL")
def required_fields(spark, d):
    """FL6, FL11: rows that pass the check are unchanged; a blank field would end the job."""
    docs = table(spark, d, "documents").filter(T.text("source").rlike(r"\S") & F.col("text").isNotNull())
    return curation.require_fields(docs, ["source"]).select("doc_id", "source")


@query("SELECT 'generated_summary_user' AS system, 'user' AS display UNION ALL SELECT 'generated_summary_assistant', 'assistant'")
def system_presence(spark, d):
    """FL12, SF22: systems that have a value in some row, and their display names."""
    turns = table(spark, d, "conversations")
    one = lambda role: F.when(F.col("role") == role, F.col("text")).alias(f"generated_summary_{role}")
    names = [f"generated_summary_{r}" for r in ("user", "assistant", "nobody", "absent")]
    found = metrics.present_systems(turns.select(one("user"), one("assistant"), one("nobody")), names)
    return spark.createDataFrame([(s,) for s in found], "system string").select("system", T.display_name("system").alias("display"))


@query("SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> '' AND (trim(coalesce(source, '')) <> '' OR (lang = 'en' AND trim(lang) <> ''))")
def scorable_rows(spark, d):
    """FL13: rows with code and some summary."""
    return metrics.scorable(table(spark, d, "documents").withColumn("en", F.when(F.col("lang") == "en", F.col("lang"))), "text", ["source", "en"]).select("doc_id")


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) SELECT a.doc_id, b.doc_id AS other_id, a.r AS zip_position FROM a JOIN b USING (r)")
def zipped_positions(spark, d):
    """JN5, JN6: rows paired by place, tables of one length."""
    docs = table(spark, d, "documents").select("doc_id")
    other = docs.select(F.col("doc_id").alias("other_id"), F.md5(F.col("doc_id").cast("string")).alias("h"))
    return splits.zip_by_position(docs, other, ["doc_id"], ["h", "other_id"], same_length=True).select("doc_id", "other_id", "zip_position")


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace('"' || coalesce(text, '') || ' '' ', '^\s+|\s+$', '', 'g'), '^["''\s]+|["''\s]+$', '', 'g'), '^$', '') AS unquoted,
regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\|\|\|', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS cleaned, regexp_replace(regexp_extract(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^[^.@]*'), '^\s+|\s+$', '', 'g') AS first_sentence FROM conversations""")
def cleaned_summaries(spark, d):
    """PJ13, PJ15, SF5, SF3: quotes, prefixes, blanks, first sentences."""
    turns = table(spark, d, "conversations")
    prefix = F.when(F.col("turn") % 3 == 0, F.lit("Final one-sentence summary (short): ")).when(F.col("turn") % 3 == 1, F.lit("SUMMARY:\n")).otherwise(F.lit(""))
    quoted = F.concat(F.lit('"'), T.text("text"), F.lit(" ' "))
    return turns.select("conv_id", "turn", T.strip_quotes(quoted).alias("unquoted"), T.meteor_clean(F.concat(prefix, T.text("text"))).alias("cleaned"), T.first_sentence("text").alias("first_sentence"))


@query("SELECT event_id, round(coalesce((value - 1) / 9.0, 0), 4) AS score, 0.0::DOUBLE AS bad FROM events")
def normalised_scores(spark, d):
    """PJ16: scores of 1 to 10 as 0 to 1; what is no number is 0."""
    return table(spark, d, "events").select("event_id", T.normalised_score("value").alias("score"), T.normalised_score("event_type").alias("bad"))


# Counters and averages


@query("""WITH k AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY source || '::' || substr(text, 1, 20) ORDER BY lang, doc_id) AS r FROM documents WHERE trim(text) <> '' AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL),
a AS (SELECT lang, count(*) AS added FROM k WHERE r = 1 GROUP BY 1), n AS (SELECT lang, count(*) AS items FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1)
SELECT lang, items, coalesce(added, 0)::BIGINT AS added, sum(coalesce(added, 0)) OVER (ORDER BY lang)::BIGINT AS total FROM n LEFT JOIN a USING (lang)""")
def reference_counters(spark, d):
    """AG10: what each architecture adds."""
    docs = table(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    return curation.reference_counters(docs, "lang", "source", "text", ["doc_id"])


@query("SELECT lang, count(l.quality) AS applied, count(*) - count(l.quality) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def reference_totals(spark, d):
    """AG10: applied and missing."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("reference")), "doc_id", "left")
    return curation.reference_totals(docs, "lang")


@query("""SELECT avg(s)::DOUBLE AS avg_strong, avg(b)::DOUBLE AS avg_backup, avg(u)::DOUBLE AS avg_uncertain FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber % 4 = 0) AS s, count(*) FILTER (WHERE l_linenumber % 4 = 1) AS b, count(*) FILTER (WHERE l_linenumber % 4 = 2) AS u FROM lineitem GROUP BY 1)""")
def denoise_averages(spark, d):
    """AG8."""
    tag = F.when(F.col("l_linenumber") % 4 == 0, denoise.STRONG).when(F.col("l_linenumber") % 4 == 1, denoise.BACKUP).when(F.col("l_linenumber") % 4 == 2, denoise.UNCERTAIN).otherwise(denoise.JUNK)
    tagged = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fn_id"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("fragment"), tag.alias("tag"))
    return denoise.averages(denoise.buckets(tagged))


@query("SELECT (sum(n) // count(*))::BIGINT AS mean_candidates FROM (SELECT len(string_split(text, ' ')) AS n FROM documents WHERE text IS NOT NULL)")
def candidate_mean(spark, d):
    """AG9."""
    return denoise.mean_candidates(table(spark, d, "documents").filter("text IS NOT NULL").select(F.split("text", " ").alias("c")), "c")


@query("SELECT avg(coalesce(value, 0))::DOUBLE AS avg_value, avg(CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END)::DOUBLE AS avg_tokens FROM events")
def averages_over_all(spark, d):
    """AG11: a missing value counts as nothing."""
    return metrics.averages_over_all(table(spark, d, "events").withColumn("tokens", F.when(F.col("event_id") % 3 == 0, F.col("event_id"))), ["value", "tokens"])


# Metrics

@query(f"""WITH {_PAIRS}, x AS (SELECT sample, len(h) AS n, len(r) AS m, h, r FROM pairs),
hw AS (SELECT sample, unnest(h) AS w, generate_subscripts(h, 1) AS i FROM x), rw AS (SELECT sample, unnest(r) AS w, generate_subscripts(r, 1) AS j FROM x)
SELECT sample, count(*) FILTER (WHERE j IS NOT NULL) AS equal_pairs FROM hw LEFT JOIN rw USING (sample, w) GROUP BY sample""")
def common_words(spark, d):
    """TX1, TX4's table of equal words: how many pairs of places hold the same word."""
    pairs = _pairs(spark, d)
    grams = lambda c: metrics.ngram_counts(pairs, "sample", c).filter("n = 1")
    both = grams("hypothesis").join(grams("reference").withColumnRenamed("count", "other"), ["sample", "n", "gram"], "left")
    return both.groupBy("sample").agg(F.sum(F.col("count") * F.coalesce("other", F.lit(0))).alias("equal_pairs"))


_ROUGE = f"""WITH RECURSIVE {_PAIRS}, x AS (SELECT sample, h, r FROM pairs),
steps AS (SELECT sample, 0 AS k, list_transform(range(0, len(r) + 1), lambda q: 0) AS v FROM x
UNION ALL SELECT s.sample, s.k + 1, list_reduce(list_prepend([0], list_transform(range(1, len(x.r) + 1), lambda j: [CASE WHEN x.r[j] = x.h[s.k + 1] THEN s.v[j] + 1 ELSE s.v[j + 1] END])), lambda a, b: list_append(a, greatest(a[-1], b[1]))) FROM steps s JOIN x USING (sample) WHERE s.k < len(x.h)),
lcs AS (SELECT sample, arg_max(v[-1], k) AS l FROM steps GROUP BY 1),
f AS (SELECT sample, CASE WHEN len(h) = 0 OR len(r) = 0 OR l = 0 THEN 0.0::DOUBLE ELSE (1 + 1.44::DOUBLE) * (l::DOUBLE / len(h)) * (l::DOUBLE / len(r)) / (l::DOUBLE / len(r) + 1.44::DOUBLE * (l::DOUBLE / len(h))) END AS rouge_l FROM x JOIN lcs USING (sample))"""


@query(f"{_ROUGE} SELECT sample, round(rouge_l, 6) AS rouge_l FROM f")
def rouge_l(spark, d):
    """TX4, TX5."""
    return metrics.rouge_l(_pairs(spark, d), "sample", "hypothesis", "reference").select("sample", F.round("rouge_l", 6).alias("rouge_l"))


@query(f"{_ROUGE} SELECT round(avg(rouge_l) * 100, 4) AS rouge_l FROM f")
def rouge_mean(spark, d):
    """AG4."""
    return metrics.mean_scores(metrics.rouge_l(_pairs(spark, d), "sample", "hypothesis", "reference"), ["rouge_l"]).select(F.round("rouge_l", 4).alias("rouge_l"))


@query(f"""{_BLEU_BASE}, z AS (SELECT *, {_G} FROM s), b AS (SELECT {_bleu_select(lambda x: x, 1.0)} FROM z), u AS (UNPIVOT b ON COLUMNS(*) INTO NAME metric VALUE score)
SELECT metric, 'assistant' AS system, round(avg(score), 4) AS average FROM u GROUP BY 1 UNION ALL SELECT metric, NULL, round(avg(score), 4) FROM u GROUP BY 1""")
def metric_table(spark, d):
    """TX7, AG5, AG6: all metrics that work, averaged with their rollup; one that fails at run time is left out."""

    def broken(pairs, key, hypothesis, reference):
        return pairs.select(key, F.raise_error(F.lit("no such metric")).cast("double").alias("broken"))

    scored, errors = metrics.score_all(_pairs(spark, d), "sample", "hypothesis", "reference", {"bleu": metrics.sentence_bleu, "broken": broken})
    assert list(errors) == ["broken"]
    long = scored.unpivot("sample", [c for c in scored.columns if c != "sample"], "metric", "score").withColumn("system", F.lit("assistant"))
    return metrics.metric_averages(long.withColumn("score", F.round("score", 6))).withColumn("average", F.round("average", 4))


_TWO = _BLEU_BASE.replace(
    "m AS (SELECT",
    "rg2 AS (SELECT sample, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM (SELECT sample, n, h[1:5] AS w FROM o) WHERE len(w) >= n), m AS (SELECT",
).replace(
    "(SELECT sample, n, gram, count(*) AS c FROM rg GROUP BY ALL) b",
    "(SELECT sample, n, gram, max(c) AS c FROM (SELECT sample, n, gram, count(*) AS c FROM rg GROUP BY ALL UNION ALL SELECT sample, n, gram, count(*) FROM rg2 GROUP BY ALL) GROUP BY ALL) b",
).replace("len(p.r)::DOUBLE AS f", "(CASE WHEN abs(len(p.h[1:5]) - len(p.h)) < abs(len(p.r) - len(p.h)) OR (abs(len(p.h[1:5]) - len(p.h)) = abs(len(p.r) - len(p.h)) AND len(p.h[1:5]) < len(p.r)) THEN len(p.h[1:5]) ELSE len(p.r) END)::DOUBLE AS f")


@query(f"{_TWO}, z AS (SELECT *, {_G} FROM s) SELECT {_bleu_select(lambda x: f'sum({x})', 100.0)} FROM z")
def bleu_several_references(spark, d):
    """TX3, AG13: two references, the second the hypothesis' own first five words; the closest length counts."""
    pairs = _pairs(spark, d).withColumn("references", F.array(T.text("reference"), F.array_join(F.slice(T.words("hypothesis"), 1, 5), " ")))
    out = metrics.corpus_bleu(pairs, "sample", "hypothesis", "references")
    return out.select(*(F.round(f"bleu_{n}", 6).alias(f"bleu_{n}") for n in range(1, 5)))


# Vectors


def _letters(texts: list[str]) -> np.ndarray:
    """An encoder for checks: length and counts of three letters."""
    return np.array([[len(t), *(t.count(c) for c in "aei")] for t in texts], float).reshape(-1, 4)


@query("SELECT doc_id, len(coalesce(text, ''))::DOUBLE AS size, (len(coalesce(text, '')) - len(replace(coalesce(text, ''), 'a', '')))::DOUBLE AS a, (len(coalesce(text, '')) - len(replace(coalesce(text, ''), 'e', '')))::DOUBLE AS e, (len(coalesce(text, '')) - len(replace(coalesce(text, ''), 'i', '')))::DOUBLE AS i FROM documents")
def encoded_texts(spark, d):
    """VC1: an encoder in batches."""
    rows = vectors.encode(table(spark, d, "documents").select("doc_id", "text"), "text", _letters)
    return rows.select("doc_id", *(F.get("embedding", F.lit(k)).alias(c) for k, c in enumerate(("size", "a", "e", "i"))))


@query(f"{_NORM} SELECT a.vec_id, round(list_dot_product(a.embedding, b.embedding), 6) AS side FROM u a JOIN u b ON b.vec_id = a.vec_id + 1")
def side_cosine(spark, d):
    """TX9, SF20: cosine of given vectors."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return vectors.cosine(pairs, "embedding", "other").select("vec_id", F.round("side", 6).alias("side"))


@query(f"""{_NORM}, t AS (SELECT vec_id // 8 AS sample, CASE WHEN vec_id % 8 < 5 THEN 'h' ELSE 'r' END AS side, embedding FROM u),
c AS (SELECT h.sample, h.embedding AS a, r.embedding AS b, list_dot_product(h.embedding, r.embedding) AS s FROM t h JOIN t r ON h.sample = r.sample AND h.side = 'h' AND r.side = 'r'),
p AS (SELECT sample, avg(m) AS p FROM (SELECT sample, max(s) AS m FROM c GROUP BY sample, a) GROUP BY 1), q AS (SELECT sample, avg(m) AS q FROM (SELECT sample, max(s) AS m FROM c GROUP BY sample, b) GROUP BY 1), n AS (SELECT DISTINCT sample FROM t)
SELECT n.sample, round(coalesce(CASE WHEN p + q <> 0 THEN 2 * p * q / (p + q) ELSE 0 END, 0), 6) AS f1 FROM n LEFT JOIN p ON p.sample = n.sample LEFT JOIN q ON q.sample = n.sample""")
def greedy_token_f1(spark, d):
    """TX8: greedy matching of given token vectors."""
    rows = _keys(spark, d).select(F.floor(F.col("key") / 8).alias("sample"), F.when(F.col("key") % 8 < 5, "h").otherwise("r").alias("side"), F.col("key").alias("pos"), F.col("embedding").alias("vec"))
    return metrics.greedy_token_f1(rows, "sample").select("sample", F.round("f1", 6).alias("f1"))


@query(f"""{_NORM}, s AS (SELECT q.vec_id AS query_id, k.vec_id AS vec_id, 'int f' || k.vec_id || '(void) ' AS signature, round(list_dot_product(q.embedding, k.embedding), 9) AS score FROM u q JOIN u k ON k.vec_id BETWEEN q.vec_id + 1 AND q.vec_id + 8)
SELECT query_id, vec_id, signature FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def signature_filter(spark, d):
    """VC6, PJ9: candidates cut to their signatures and ranked."""
    keys = _keys(spark, d)
    own = keys.select(F.col("key").alias("query_id"), F.col("embedding").alias("q"), F.explode(F.sequence(F.col("key") + 1, F.col("key") + 8)).alias("vec_id"))
    cands = own.join(keys.select(F.col("key").alias("vec_id"), F.col("embedding").alias("k")), "vec_id").withColumn("source", F.concat(F.lit("int f"), F.col("vec_id").cast("string"), F.lit("(void) { return 1; }")))
    return vectors.filter_signatures(cands, "query_id", "vec_id", "source", "q", "k").select("query_id", "vec_id", "signature")


@query("WITH e AS (SELECT DISTINCT l_orderkey AS target, l_partkey AS neighbour, 0 AS edge_type FROM lineitem UNION SELECT l_orderkey, l_suppkey, 1 FROM lineitem) SELECT target, neighbour, edge_type FROM (SELECT *, row_number() OVER (PARTITION BY target, edge_type ORDER BY neighbour) AS r FROM e) WHERE r <= 5")
def star_edges(spark, d):
    """GR18: five callers and five callees around each function."""
    items = table(spark, d, "lineitem")
    side = lambda c: items.select(F.col("l_orderkey").alias("target"), F.col(c).alias("neighbour"))
    return callgraph.star_edges(side("l_partkey"), side("l_suppkey"))


@query("WITH e AS (SELECT vec_id, unnest(range(vec_id + 1, vec_id + 4)) AS other FROM embeddings) SELECT e.vec_id, round(avg(k.embedding[1]::DOUBLE), 6) AS first, round(avg(k.embedding[64]::DOUBLE), 6) AS last FROM e JOIN embeddings k ON k.vec_id = e.other GROUP BY 1")
def mean_neighbours(spark, d):
    """GR19's mean aggregation."""
    rows = table(spark, d, "embeddings")
    edges = rows.select("vec_id", F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 3)).alias("other"))
    found = callgraph.mean_neighbours(edges, rows.select(F.col("vec_id").alias("other"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), "vec_id", "other")
    return found.select("vec_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(F.get("embedding", F.lit(63)), 6).alias("last"))


@query(f"""WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS embedding FROM embeddings), pool AS (SELECT * FROM u ORDER BY vec_id LIMIT 100),
s AS (SELECT 'first' AS pool, q.vec_id AS query_id, k.vec_id AS vec_id, round(list_dot_product(q.embedding, k.embedding), 9) AS score FROM u q, pool k WHERE q.vec_id % 20 = 0
UNION ALL SELECT 'all', q.vec_id, k.vec_id, round(list_dot_product(q.embedding, k.embedding), 9) FROM u q, u k WHERE q.vec_id % 20 = 0)
SELECT pool, query_id, vec_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pool, query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def retrieve_from_files(spark, d):
    """VC4: queries and a pool from saved tables; all keys, and a pool of the first ones, which is a feature of the operator."""
    folder = scratch_folder(spark)
    keys = _keys(spark, d)
    sinks.write_table(keys, f"{folder}/keys")
    sinks.write_table(keys.filter("key % 20 = 0"), f"{folder}/queries")
    found = lambda name, size: vectors.retrieve_from_files(spark, f"{folder}/queries", f"{folder}/keys", k=3, pool_size=size).select(F.lit(name).alias("pool"), "query_id", F.col("key").alias("vec_id"), "rank")
    return found("all", None).unionByName(found("first", 100))


# Training sets

_SPLIT = "WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)"


def _training_rows(spark: SparkSession, d: str) -> DataFrame:
    near = F.create_map(F.lit("b"), F.struct(F.col("n_chars").alias("v")), F.lit("a"), F.struct(F.col("doc_id").alias("v")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("fn_id"), F.concat(F.lit("int f"), F.col("doc_id").cast("string"), F.lit(" { }")).alias("source_code"), F.col("source").alias("strip_decompiled_code"), F.col("lang").alias("comment"), F.struct("lang").alias("codeart"), near.alias("caller_code"), near.alias("callee_code"))


@query(f"{_SPLIT} SELECT doc_id AS fn_id, CASE WHEN r <= n * 8 // 10 THEN 'train' WHEN r <= n * 9 // 10 THEN 'valid' ELSE 'test' END AS split, 'int f' || doc_id || ' ' AS src, doc_id AS first_caller, n_chars AS second_caller FROM n")
def signature_training_set(spark, d):
    """VC13, SK7, PJ17, PJ18, VC14's data: a saved contrastive set with signatures as sources."""
    path = f"{scratch_folder(spark)}/set"
    training.save(training.signature_set(_training_rows(spark, d)), path)
    return spark.read.parquet(path).select("fn_id", "split", "src", F.get("callers", F.lit(0))["v"].alias("first_caller"), F.get("callers", F.lit(1))["v"].alias("second_caller"))


@query(f"{_SPLIT} SELECT doc_id AS fn_id, source AS strip_decompiled_code, lang AS comment, 2::BIGINT AS n_callees FROM n WHERE r > n * 9 // 10")
def probing_set(spark, d):
    """VC13: test functions with code, comment and neighbours."""
    return training.probing_set(_training_rows(spark, d)).select("fn_id", "strip_decompiled_code", "comment", F.size("callees").cast("long").alias("n_callees"))


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id FROM part), names AS (SELECT 'checkpoint-' || p_partkey AS name, p_partkey AS k FROM part UNION ALL SELECT 'runs-' || p_partkey, NULL FROM part) SELECT arg_max(name, k) AS checkpoint FROM names""")
def checkpoint_pick(spark, d):
    """WN14: the largest number among names of several kinds."""
    names = table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit("checkpoint-"), F.col("p_partkey").cast("string")), F.concat(F.lit("runs-"), F.col("p_partkey").cast("string")), F.concat(F.lit("checkpoint-"), "p_name"))).alias("name"))
    return sinks.latest_checkpoint(spark, names)


# Model verbs


def _hash(s: str) -> str:
    return hashlib.md5(s.encode()).hexdigest()


def _says(prompt: str) -> str:
    """A reply that SQL can make, too."""
    return f"Does {_hash(prompt)[:8]}."


_REFERENCE = "'In one sentence of at most 30 words, state what this C function is for.' || chr(10) || chr(10) || text"


@query(f"""WITH k AS (SELECT source || '::' || substr(text, 1, 20) AS key, arg_min(text, doc_id) AS text FROM documents WHERE trim(text) <> '' AND text IS NOT NULL GROUP BY 1)
SELECT d.doc_id AS fn_id, CASE WHEN k.text IS NOT NULL THEN 'Does ' || (SELECT substr(md5({_REFERENCE.replace("text", "k.text")}), 1, 8)) || '.' END AS reference FROM documents d LEFT JOIN k ON k.key = d.source || '::' || substr(d.text, 1, 20)""")
def augref(spark, d):
    """LM1, LM11, SC19, SF6: references by key, asked once for each."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("fn_id"), F.col("source").alias("project_name"), F.col("text").alias("source_code"))
    return pipeline.augref(docs, _says).select("fn_id", "reference")


@query("""SELECT doc_id AS fn_id, 'M1' AS generation_mode, 'Does ' || substr(md5('Summarise this decompiled function in one sentence.' || chr(10) || chr(10) || 'Code:' || chr(10) || coalesce(text, '')), 1, 8) || '.' AS generated_summary FROM documents
UNION ALL SELECT doc_id, 'M3', 'Does ' || substr(md5('Summarise this decompiled function in one sentence.' || chr(10) || chr(10) || 'Code:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Behaviour along its paths:' || chr(10) || 'Does ' || substr(md5('Describe each execution path below, and what they do together. Reply in JSON: {"path_summaries": {"path_1": "..."}, "global_summary": "..."}' || chr(10) || chr(10) || 'Path 0:' || chr(10) || 'push rbp' || chr(10) || 'retn'), 1, 8) || '.' || chr(10) || chr(10) || 'Source fragments that may be related, tagged by confidence:' || chr(10) || '[1] int f' || doc_id || ';' || chr(10) || '[2] int g;'), 1, 8) || '.' FROM documents""")
def generated_summaries(spark, d):
    """LM2, LM6, PJ12, SF7: summaries from code alone, and with paths and raw snippets."""
    block = lambda asm, succ: {"instructions": [{"disassembly": asm}], "successors": succ}
    cfg = F.from_json(F.lit(json.dumps({"1": block("push rbp", [2]), "2": block("retn", [])})), f"map<string,{BLOCK}>")
    fns = table(spark, d, "documents").select(F.col("doc_id").alias("fn_id"), F.col("text").alias("strip_decompiled_code"), F.lit(None).cast("string").alias("reference"), F.lit(None).cast("string").alias("source_code"), F.transform_keys(cfg, lambda k, _: k.cast("bigint")).alias("cfg"))
    cands = fns.select("fn_id", F.array(F.concat(F.lit("x<asm_token>\nint f"), F.col("fn_id").cast("string"), F.lit(";")), F.lit("<b>int g;</b>"), F.lit("  ")).alias("probed_sources"))

    def provider(prompt: str) -> str:
        return json.dumps({"path_summaries": {}, "global_summary": f'"{_says(prompt)}" '}) if "global_summary" in prompt else f"<think>so</think> {_says(prompt)}"

    out = pipeline.generate(fns, provider, "M1").unionByName(pipeline.generate(fns, provider, "M3", cands))
    return out.select("fn_id", "generation_mode", "generated_summary")


@query("""WITH c AS (SELECT doc_id, unnest([0, 1, 2]) AS k FROM documents), t AS (SELECT doc_id, k, CASE WHEN k = doc_id % 3 THEN 'junk' WHEN NOT contains(coalesce(text, ''), 'the') THEN 'uncertain' WHEN k = 0 THEN 'strong' WHEN k = 1 THEN 'backup' ELSE 'junk' END AS tag FROM c JOIN documents USING (doc_id))
SELECT doc_id AS fn_id, coalesce(string_agg('int v' || k || ';', ' ' ORDER BY k) FILTER (WHERE tag = 'strong'), '') AS strong, coalesce(string_agg('int v' || k || ';', ' ' ORDER BY k) FILTER (WHERE tag = 'backup'), '') AS backup, coalesce(string_agg('int v' || k || ';', ' ' ORDER BY k) FILTER (WHERE tag = 'uncertain'), '') AS uncertain FROM t GROUP BY 1""")
def denoised_candidates(spark, d):
    """LM3, LM4, LM5, JN10, FL10: both stages' replies, every fragment labelled; features count only if they stand in the code."""
    docs = table(spark, d, "documents")
    fns = docs.select(F.col("doc_id").cast("string").alias("fn_id"), F.col("text").alias("strip_decompiled_code"))
    # The junk fragment of a document has another letter.
    cands = fns.select("fn_id", F.array(*(F.concat(F.lit("int "), F.when(F.col("fn_id").cast("long") % 3 == k, "w").otherwise("v"), F.lit(f"{k};")) for k in range(3))).alias("probed_sources"))

    def provider(prompt: str) -> str:
        if "junk or not" in prompt:
            return "So: " + json.dumps({"results": [{"index": k, "is_junk": f"[{k + 1}] int w{k};" in prompt} for k in range(3)]})
        return json.dumps({"has_strong_features": True, "extracted_features": ["the", "\u0000none"], "results": [{"index": 0, "is_source_match": True, "is_domain_match": True}, {"index": 1, "is_source_match": False, "is_domain_match": True}]})

    out = pipeline.denoised(fns, cands, provider)
    return out.select(F.col("fn_id").cast("long").alias("fn_id"), *(F.array_join(f"filter_{t}", " ").alias(t) for t in ("strong", "backup", "uncertain")))


@query("""SELECT doc_id AS fn_id, s AS system, round((CASE WHEN s = 'A' THEN doc_id % 10 ELSE 4 END) / 9.0, 4) AS accuracy, CASE WHEN s = 'A' THEN 1.0::DOUBLE ELSE round(1 / 9.0, 4) END AS coverage, CASE WHEN s = 'A' THEN NULL ELSE 0.0::DOUBLE END AS effectiveness FROM documents, (VALUES ('A'), ('B')) t(s)""")
def judged_summaries(spark, d):
    """LM7: semantics, claims and scores of two systems, three calls a sample."""

    def provider(prompt: str) -> str:
        if "accuracy, coverage and effectiveness" in prompt:
            n = int(prompt.rsplit("#", 1)[1].split("!")[0])
            return "Scores: " + json.dumps({"A": {"accuracy": n % 10 + 1, "coverage": 10}, "B": {"accuracy": 5, "coverage": 2, "effectiveness": 1}})
        return prompt[prompt.rindex("#") :] if "#" in prompt else ""

    rows = table(spark, d, "documents").select(F.col("doc_id").alias("fn_id"), F.concat(F.lit("#"), F.col("doc_id").cast("string"), F.lit("!")).alias("source_code"), F.lit("does").alias("generated_summary_A"), F.concat(F.lit("#"), F.col("doc_id").cast("string"), F.lit("!")).alias("generated_summary_B"))
    return pipeline.judge_summaries(rows, ["A", "B"], provider)


@query("""WITH t AS (SELECT l_orderkey, l_linenumber::DOUBLE AS v, -l_discount * 10 AS lp FROM lineitem) SELECT l_orderkey, round(sum(exp(lp) * v) / sum(exp(lp)), 6) AS expected FROM t GROUP BY 1""")
def logprob_score(spark, d):
    """SF15: the expectation over digit alternatives; others don't count."""
    alternatives = F.collect_list(F.struct(F.concat(F.lit(" "), F.col("l_linenumber").cast("string")).alias("token"), (-F.col("l_discount") * 10).alias("logprob")))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(alternatives.alias("top"))
    other = F.array(F.struct(F.lit("no").alias("token"), F.lit(0.0).alias("logprob")), F.struct(F.lit("11").alias("token"), F.lit(0.0).alias("logprob")))
    return rows.select("l_orderkey", F.round(T.expected_score(F.concat("top", other)), 6).alias("expected"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber AS n, min(l_discount)::DOUBLE * 10 AS a, min(l_tax)::DOUBLE * 10 AS b FROM lineitem GROUP BY ALL),
e AS (SELECT *, (exp(-a) * n + exp(-b) * (n + 2)) / (exp(-a) + exp(-b)) AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS r, count(*) OVER (PARTITION BY l_orderkey) AS c FROM t)
SELECT l_orderkey, round(max(s) FILTER (r = 1 AND c = 3), 6) AS accuracy, round(max(s) FILTER (r = 2 AND c = 3), 6) AS coverage, round(max(s) FILTER (r = 3 AND c = 3), 6) AS effectiveness FROM e GROUP BY l_orderkey""")
def weighted_scores(spark, d):
    """LM8: an order's lines are the digits of a reply, each with two alternatives by discount and tax; there are scores only where there are three digits."""
    alternative = lambda n, lp: F.struct(n.cast("string").alias("token"), (-lp * 10).alias("logprob"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(F.min("l_discount").alias("a"), F.min("l_tax").alias("b"))
    digit = F.struct("n", F.struct(F.col("n").cast("string").alias("token"), F.array(alternative(F.col("n"), F.col("a")), alternative(F.col("n") + 2, F.col("b"))).alias("top_logprobs")).alias("t"))
    brace = F.struct(F.lit("{").alias("token"), F.array(F.struct(F.lit("{").alias("token"), F.lit(0.0).alias("logprob"))).alias("top_logprobs"))
    replies = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(digit)), lambda x: x["t"]).alias("digits"))
    scores = judge.weighted_scores(F.concat(F.array(brace), "digits"), 1)
    return replies.select("l_orderkey", *(F.round(F.get(scores, F.lit(k)), 6).alias(c) for k, c in enumerate(judge.CRITERIA)))
