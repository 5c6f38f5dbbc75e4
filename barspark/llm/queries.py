"""One query per corpus operator over the given tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import bpe, chunk_dedup, decontaminate, html_extract, license_scan, merkle, ngram_join, prefix_forest, secret_scan, simhash, spelling, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BPE_FILE = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
TOXIC = 0.7


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query
def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(texts(spark, sf_dir))
    spans = F.col("secrets")
    counts = [F.size(secret_scan.of_kinds(spans, [k])).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    base = secret_scan.joined(secret_scan.of_kinds(spans, secret_scan.BASE))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_scan.joined(spans).alias("spans"))


def held_out() -> Column:
    """Rows that nothing is learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~held_out()))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    toxic = (F.col("score") >= TOXIC).cast("int")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", toxic.alias("predicted"))


@query
def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(texts(spark, sf_dir), public_tokenizers.path(BPE_FILE))
    n = F.col("n_tokens")
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n, (n > TOKEN_LIMIT).alias("over_limit"))


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(texts(spark, sf_dir), size=4, percent=85)


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(texts(spark, sf_dir), public_tokenizers.path(BPE_FILE))
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup.repeated_passages(texts(spark, sf_dir))
    ranges = F.transform("passages", lambda p: F.concat_ws(":", p["first"].cast("string"), p["stop"].cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_chunks",
        "repeated_words",
        "removed_words",
        (F.col("repeated_words") > 0).alias("repeated"),
        F.array_join(ranges, ",").alias("passages"),
    )


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan_licenses(texts(spark, sf_dir))
    at = F.transform("places", lambda p: p["at"].cast("long"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(license_scan.labels(), ",").alias("labels"),
        "score",
    )


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(texts(spark, sf_dir))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's checksum 5 divides are checked with their text in lower case."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lowered = {"text": F.translate("text", _UPPER, _LOWER)}
    made = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], changed=(chosen, lowered))
    root = F.lit(made.root)
    return made.checks().select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        root.alias("root"),
        F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == root).alias("verified"),
    )


@query
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(texts(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op9_decontaminate"] = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS words
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS words
          FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s
                FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
met AS (SELECT doc_id, item_id, s, size FROM place JOIN win USING (size, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_SPACED = _WORDS.replace("\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F", "\\x20\\x09-\\x0D")

ORACLES["op6_ngram_join"] = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_SPACED} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 4 THEN CASE WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END
         ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM doc),
one AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM sets),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b USING (g) WHERE a.doc_id <> b.doc_id
         GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sets
"""

#: CRC-32 with its table made from the polynomial; ``crc(bytes)`` takes a list of byte values.
_CRC_TABLE = """(SELECT list(r ORDER BY i) FROM (SELECT i, list_reduce(range(0, 8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS r FROM range(0, 256) r(i)))"""


def _crc(value: str, tables: str) -> str:
    codes = f"list_transform(range(0, length(hex({value})) // 2), lambda k: ('0x' || substr(hex({value}), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, {tables}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def _manifest_sql(heights: int = 5) -> str:
    """Trees of up to 16 ** heights leaves, level by level."""

    def field(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    leaf, other = (f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', t))})" for t in ("text", lowered))
    steps = []
    for tree, group in (("doc", "source"), ("src", "grp")):
        for k in range(heights):
            steps.append(f"{tree}run{k} AS (SELECT {group}, i // 16 AS i, (n + 15) // 16 AS n, list(node ORDER BY i) AS nodes FROM {tree}{k} WHERE n > 1 GROUP BY {group}, i // 16, n)")
            steps.append(f"{tree}{k + 1} AS (SELECT {group}, i, n, sha256(array_to_string(nodes, '')) AS node FROM {tree}run{k})")
        tops = " UNION ALL ".join(f"SELECT {group}, node FROM {tree}{k} WHERE n = 1" for k in range(heights + 1))
        steps.append(f"{tree}top AS ({tops})")
        if tree == "doc":
            steps.append("src0 AS (SELECT 0 AS grp, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, node FROM doctop)")
    columns, last = "doc_id, source, leaf, subroot, root", "path0"
    steps.append(
        "path0 AS (SELECT d.doc_id, d.source, d.i AS di, s.i AS si, d.node AS leaf, s.node AS subroot, t.node AS root, '' AS chain, d.other AS folded "
        "FROM doc0 d JOIN src0 s ON s.source IS NOT DISTINCT FROM d.source, srctop t)"
    )
    for tree, at, match in (("doc", "di", "r.source IS NOT DISTINCT FROM p.source AND"), ("src", "si", "")):
        for k in range(heights):
            own = f"(p.{at} // {16**k}) % 16"
            left, right = f"array_to_string(r.nodes[1:{own}], '')", f"array_to_string(r.nodes[{own} + 2:], '')"
            steps.append(
                f"{tree}path{k} AS (SELECT {columns.replace('source', 'p.source')}, di, si, CASE WHEN r.nodes IS NULL THEN chain ELSE chain || {left} || {right} END AS chain, "
                f"CASE WHEN r.nodes IS NULL THEN folded ELSE sha256({left} || folded || {right}) END AS folded "
                f"FROM {last} p LEFT JOIN {tree}run{k} r ON {match} r.i = p.{at} // {16 ** (k + 1)})"
            )
            last = f"{tree}path{k}"
    chain = ",\n".join(steps)
    return f"""
WITH tables AS (SELECT {_CRC_TABLE} AS t),
made AS (SELECT doc_id, source, {leaf} AS node, CASE WHEN {_crc("doc_id::VARCHAR", "t")} % 5 = 0 THEN {other} ELSE {leaf} END AS other FROM documents, tables),
doc0 AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, node, other FROM made),
{chain}
SELECT doc_id, leaf, subroot, root, sha256(chain) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {last}
"""


ORACLES["op12_merkle_manifest"] = _manifest_sql()

ORACLES["op11_spelling_variants"] = f"""
WITH RECURSIVE tables AS (SELECT {_CRC_TABLE} AS t),
run AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents) GROUP BY doc_id, w),
marked AS (SELECT w, n, {_crc("(coalesce(doc_id::VARCHAR, '') || ':' || w)", "t")} AS h FROM run, tables),
word AS (SELECT w, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, n FROM marked)
         GROUP BY w HAVING length(w) >= 5 AND sum(n) >= 3),
cut AS (SELECT w, n, i, w[1:i] || w[i + 2:] AS c FROM (SELECT w, n, unnest(range(0, length(w))) AS i FROM word)),
near AS (SELECT a.w AS w, b.w AS v, b.n AS vn FROM cut a JOIN cut b ON a.i = b.i AND a.c = b.c AND a.w <> b.w
         UNION SELECT a.w, b.w, b.n FROM cut a JOIN word b ON a.c = b.w
         UNION SELECT b.w, a.w, a.n FROM cut a JOIN word b ON a.c = b.w),
best AS (SELECT w, count(*) AS n_near, arg_min(v, (-vn, v)) AS form, max(vn) AS form_n FROM near GROUP BY w),
formed AS (SELECT word.w, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * word.n THEN form END AS form,
           CASE WHEN form_n >= 2 * word.n THEN form_n END AS form_n FROM word LEFT JOIN best USING (w)),
way AS (SELECT w, w AS at FROM formed UNION SELECT way.w, formed.form FROM way JOIN formed ON formed.w = way.at WHERE formed.form IS NOT NULL),
root AS (SELECT way.w, way.at AS root FROM way JOIN formed ON formed.w = way.at WHERE formed.form IS NULL)
SELECT w AS word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM formed JOIN root USING (w)
"""
