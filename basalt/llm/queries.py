"""The thin queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import conversation_repair, langid, spelling, toxicity, url_filter
from basalt.llm.common import documents
from basalt.llm.exact_dedup import exact_dedup, normalised
from basalt.llm.hamming_topk import top_k
from basalt.llm.license_scan import scan_licenses
from basalt.llm.line_runs import drop_frequent_lines
from basalt.llm.mixing import ordered_plan, plan_mix
from basalt.llm.packing import pack
from basalt.llm.simhash import near_duplicates
from basalt.llm.unigram_counts import token_counts


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), carry={"text_sha256": F.sha2(normalised("text"), 256)})


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = langid.fold("doc_id", 5) == 0
    model = toxicity.fit(docs, labels.filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_frequent_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = langid.fold("doc_id", 3) == 1
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_plan(plan_mix(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    fixed = conversation_repair.repair(conversation_repair.damaged(rows))
    known = fixed.conversations.unionByName(conversation_repair.digests(fixed.pieces), allowMissingColumns=True)
    # Conversations that have lost all rows are known by their ids alone.
    known = known.unionByName(rows.select("conv_id").distinct(), allowMissingColumns=True)
    counts = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return known.groupBy("conv_id").agg(*counts, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spelling.word_counts(documents(spark, sf_dir), damage=97)
    return spelling.variants(counted.filter("n >= 3"))


#: The rules that the query is given.
URL_RULES = [
    url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/"),
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose id is the last number of its path; URLs of documents that are labelled toxic or of low quality are to be blocked."""
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    _, path = url_filter.host_and_path(F.col("url"))
    shown = pages.select("url", F.regexp_extract(path, "([0-9]+)[^0-9]*$", 1).try_cast("long").alias("doc_id"))
    block = F.when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False)))
    labelled = shown.join(labels.select("doc_id", block.alias("block")), "doc_id").select("url", "block")
    return url_filter.filter_urls(pages, labelled, URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_hamming_topk": op7_hamming_topk,
    "op8_langid": op8_langid,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_url_filter": op13_url_filter,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 in SQL: a table of 256 remainders, and a fold over a string's UTF-8 bytes (for characters up to U+07FF).
_CRC_TABLE = """
        crc(i, k, c) AS (SELECT range, 0, range::UBIGINT FROM range(256) UNION ALL
                         SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM crc WHERE k < 8),
        tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8)"""
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split({0}, ''), lambda x:
                    CASE WHEN ord(x) < 128 THEN [ord(x)::UBIGINT] ELSE [(192 + ord(x) // 64)::UBIGINT, (128 + ord(x) % 64)::UBIGINT] END))),
                    lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)::INT])), 4294967295::UBIGINT)"""

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
    "op6_line_dedup": rf"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
             lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM docs),
             keyed AS (SELECT *, {_LOWER.format("regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} AS k FROM lines),
             often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(o.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN often o ON keyed.k = o.k GROUP BY doc_id""",
    "op7_hamming_topk": """
        WITH c AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code FROM embeddings WHERE embedding IS NOT NULL),
             d AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, bit_count(xor(q.code, c.code))::INT AS distance FROM c q, c WHERE q.vec_id % 20 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d)
        SELECT query_id, neighbour_id, distance, rank::INT AS rank FROM r WHERE rank <= 10""",
    "op9_mixing": r"""
        WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
                          md5(coalesce(doc_id::VARCHAR, '') || '#' || md5(coalesce(text, ''))) AS mark,
                          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
             s AS (SELECT key, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY key) - 1 AS r FROM d GROUP BY key),
             w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][r % 3 + 1] AS weight, [0.25::DOUBLE, 0.0::DOUBLE, -0.25::DOUBLE][r % 3 + 1] AS slope, source_size * 2.0::DOUBLE AS cap FROM s),
             l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - sum(cap) OVER o + cap) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level FROM w WINDOW o AS (ORDER BY cap / weight, key)),
             c AS (SELECT *, cap / weight <= level AS capped, arg_min(level, cap / weight) FILTER (WHERE cap / weight > level) OVER () AS top FROM l),
             t AS (SELECT key, source_size, slope, CASE WHEN capped THEN cap ELSE top * weight END AS target FROM c),
             p AS (SELECT doc_id, size, source_size, slope, target, round(target)::BIGINT AS goal, sum(size) OVER (PARTITION BY d.key ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start FROM d JOIN t ON d.key = t.key),
             e AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS epochs FROM p),
             k AS (SELECT *, size * epochs + greatest(0, least(size, goal - epochs * source_size - start)) AS taken, least(greatest(start::DOUBLE / target, 0.0), 1.0) AS q FROM e)
        SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
               CASE WHEN taken > 0 THEN round(2 * q / (slope + 1 + sqrt(greatest((slope + 1) * (slope + 1) - 4 * slope * q, 0.0))), 9) END AS position FROM k""",
    "op11_conversation_repair": rf"""
        WITH RECURSIVE {_CRC_TABLE},
        ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
        keyed AS (SELECT g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f
                  FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id, tab),
        hurt AS (SELECT g, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                        unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE f <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS r FROM hurt),
        faults AS (SELECT *, left(role, 1) AS ini, lead(left(role, 1)) OVER (PARTITION BY g ORDER BY r) AS following,
                          CASE WHEN regexp_full_match(text, '[\x20\x09-\x0D]*') THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY r) > 1 THEN 'd'
                               WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN '-' ELSE 't' END AS fault FROM placed),
        stats AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (following IS NOT NULL AND ini || following NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY g),
        moves(i, j, c, l, o) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (3, 2, 2, 'I', chr(10) || 'user:'),
                  (2, 3, 2, 'I', chr(10) || 'assistant:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
        steps(ini, i, j) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
        acts AS (SELECT 'K' AS l, ini, i, j, 0 AS c FROM steps UNION ALL SELECT 'R', ini, i, j, 2 FROM steps WHERE ini <> 's' UNION ALL SELECT 'D', NULL, i, i, 3 FROM (VALUES (0), (1), (2), (3)) s(i)),
        dp(g, r, state, best) AS (
            SELECT g, 0::BIGINT, 0, {{'c': 0::BIGINT, 'a': '', 'o': ''}} FROM ids UNION ALL
            SELECT f.g, f.r, a.j, min({{'c': best.c + m.c + a.c + CASE WHEN a.l <> 'D' AND fault = 't' THEN 1 ELSE 0 END, 'a': best.a || m.l || a.l,
                   'o': best.o || m.o || CASE a.l WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE a.ini WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text END}})
            FROM dp JOIN faults f ON f.g = dp.g AND f.r = dp.r + 1 JOIN moves m ON m.i = dp.state JOIN acts a ON a.i = m.j
            WHERE a.l = 'D' OR fault NOT IN ('b', 'd') AND (a.l = 'R' OR a.ini = f.ini) GROUP BY f.g, f.r, a.j),
        ends AS (SELECT dp.g, min({{'c': best.c + m.c, 'a': best.a || m.l, 'o': best.o || m.o}}) AS best FROM dp JOIN stats ON dp.g = stats.g AND dp.r = stats.n JOIN moves m ON m.i = dp.state WHERE m.j IN (0, 3) GROUP BY dp.g)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256 FROM ids LEFT JOIN stats USING (g) LEFT JOIN ends USING (g)""",
    "op12_spelling_variants": rf"""
        WITH RECURSIVE {_CRC_TABLE},
        runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
        hashed AS (SELECT run, n, {_CRC.format("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted, tab),
        typed AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        cuts AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        near AS (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                 UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
        best AS (SELECT word, count(*) AS n_near, min({{'n': -m, 'w': other}}) AS top FROM near GROUP BY word),
        forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.n >= 2 * n THEN top.w END AS form, CASE WHEN -top.n >= 2 * n THEN (-top.n)::BIGINT END AS form_n FROM words LEFT JOIN best ON words.word = best.word),
        chain AS (SELECT word, word AS here, 0 AS k FROM forms UNION ALL SELECT chain.word, form, k + 1 FROM chain JOIN forms ON chain.here = forms.word WHERE form IS NOT NULL),
        ends AS (SELECT word, arg_max(here, k) AS root FROM chain GROUP BY word)
        SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ends ON forms.word = ends.word""",
    "op13_url_filter": rf"""
        WITH cut AS (SELECT page_id, url, {_LOWER.format("coalesce(url, '')")} AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (SELECT page_id, url, low, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        given AS (SELECT host, path, max({{'n': length(h || p), 'rule': h || p, 'verdict': verdict}}) AS best FROM (SELECT DISTINCT host, path FROM split) s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
        lowered AS (SELECT *, {_LOWER.format("path")} AS lpath FROM split),
        parted AS (SELECT page_id, url, host, path, list_sort(list_distinct(list_concat(
                CASE WHEN strpos(low, '://') > 1 THEN ['s:' || split_part(low, '://', 1)] ELSE [] END,
                list_transform(list_filter(string_split(regexp_replace(host, ':[0-9]*$', ''), '.'), lambda x: x <> ''), lambda x: 'h:' || x),
                list_transform(list_filter(string_split(regexp_replace(lpath, '\.[a-z0-9]{{1,8}}$', ''), '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN 'p:#' ELSE 'p:' || x END),
                CASE WHEN regexp_extract(lpath, '\.([a-z0-9]{{1,8}})$', 1) <> '' THEN ['x:' || regexp_extract(lpath, '\.([a-z0-9]{{1,8}})$', 1)] ELSE [] END,
                list_transform(list_filter(list_transform(string_split(regexp_extract(low, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'q:' || x),
                CASE WHEN contains(low, '#') THEN ['f:'] ELSE [] END))) AS parts FROM lowered),
        labelled AS (SELECT parts, CASE WHEN coalesce(toxic = 1, false) OR coalesce(quality = 0, false) THEN 'block' ELSE 'allow' END AS verdict
                     FROM parted JOIN labels ON try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) = doc_id WHERE (toxic IS NOT NULL OR quality IS NOT NULL) AND len(parts) > 0),
        least AS (SELECT ceil(least(1.0::DOUBLE, greatest(0.002::DOUBLE, 5 / count(*)::DOUBLE)) * count(*)) AS n FROM labelled),
        often AS (SELECT part FROM (SELECT unnest(parts) AS part FROM labelled) GROUP BY part HAVING count(*) >= (SELECT n FROM least)),
        kept AS (SELECT list_filter(parts, lambda x: list_contains(known, x)) AS parts, verdict FROM labelled, (SELECT list(part) AS known FROM often)),
        subsets AS (SELECT list_filter(parts, lambda x, i: (mask // (2 ** (i - 1))::BIGINT) % 2 = 1) AS items, verdict FROM (SELECT parts, verdict, unnest(range(1, (2 ** len(parts))::BIGINT)) AS mask FROM kept)),
        freq AS (SELECT items, count(*) AS n FROM subsets GROUP BY items),
        mined AS (SELECT s.items, verdict, count(*) AS support, count(*) / any_value(f.n)::DOUBLE AS confidence FROM subsets s JOIN freq f ON s.items = f.items GROUP BY s.items, verdict
                  HAVING count(*) >= (SELECT n FROM least) AND count(*) / any_value(f.n)::DOUBLE >= 0.6),
        matched AS (SELECT parts, min({{'c': -confidence, 's': -support, 'n': len(items), 'v': verdict <> 'block', 'i': items, 'verdict': verdict}}) AS best
                    FROM (SELECT DISTINCT parts FROM parted) p JOIN mined ON list_has_all(p.parts, mined.items) GROUP BY parts)
        SELECT page_id, s.host, s.path, given.best.rule AS rule, coalesce(given.best.verdict, matched.best.verdict, 'allow') AS verdict,
               CASE WHEN given.best IS NULL THEN -matched.best.c END AS confidence, CASE WHEN given.best IS NULL THEN matched.best.i END AS items
        FROM parted s LEFT JOIN given ON s.host = given.host AND s.path = given.path LEFT JOIN matched ON s.parts = matched.parts""",
}
