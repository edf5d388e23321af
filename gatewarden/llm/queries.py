"""Registered queries of the training-data operators: each applies its operator,
with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding, fim, langid, lexical, licenses, linededup, minhash, mixing, packing, quality, sharding, urlfilter

SHARDS = 24
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Both turns of conversation -7.
PLANTED_TURN = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs).select("doc_id", "class_id", "copy_id", "kept")


def tokenizer_path() -> str:
    """The tokenizer's file, at the same place on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.line_classes(docs, short=True).select("doc_id", "line_no", "class_id", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = langid.fit(docs, langid.in_training(F.col("doc_id")))
    told = langid.detect(docs.select("doc_id", "text"), known)
    return told.select(
        "doc_id",
        F.coalesce(~langid.in_training(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "lid.lang_pred",
        "lid.score",
        "lid.second",
        "lid.rejected",
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_table(docs, sharding.uniform_tree(SHARDS), sharding.uniform_tree(SHARDS + 1))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, spark.createDataFrame(URL_RULES, "verdict string, host string, path string"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED_TURN), (-7, 1, "assistant", PLANTED_TURN)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_log(chat.as_events(rows.unionByName(planted))))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fim.fill_in_middle(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_packing,
        op3_line_dedup,
        op4_language_id,
        op5_sharding,
        op6_url_filter,
        op7_license_scan,
        op8_mixing,
        op9_quality_rules,
        op10_embedding_dedup,
        op11_lexical_search,
        op12_chat_format,
        op13_fill_in_middle,
    )
}

OP6_SQL = """
WITH u AS (
  SELECT page_id, url, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN NULL ELSE substr(url, instr(url, '://') + 3) END AS rest
  FROM pages),
p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT p.page_id, r.verdict, r.rhost || r.rpath AS rule,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost) DESC, length(r.rpath) DESC) AS k
  FROM p JOIN r ON (p.host = r.rhost OR p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    t = f"lower({text})"
    for spelling, usual in licenses.SPELLINGS:
        t = f"replace({t}, {_quoted(spelling)}, {_quoted(usual)})"
    t = f"regexp_replace({t}, {_quoted(licenses.COPYRIGHT_LINE)}, ' ', 'g')"
    return f"nullif(trim(regexp_replace({t}, {_quoted(licenses.NO_WORD)}, ' ', 'g')), '')"


OP7_SQL = f"""
WITH known(license, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses.known_texts())}),
k AS (SELECT md5({_canonical_sql("text")}) AS d, min(license) AS license FROM known GROUP BY 1),
whole AS (SELECT doc_id, md5({_canonical_sql("coalesce(text, '')")}) AS digest FROM documents),
units AS (
  SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), {_quoted(licenses.SENTENCE_END)}, '\\1' || chr(10), 'g'), chr(10))) AS unit
  FROM documents),
hits AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n
  FROM units JOIN k ON md5({_canonical_sql("unit")}) = k.d GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license, h.notices, coalesce(h.n, 0) AS n_notices
FROM whole w LEFT JOIN k ON w.digest = k.d LEFT JOIN hits h ON w.doc_id = h.doc_id
"""

TERM_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS id, doc_id, {TERM_SQL} AS ts FROM documents),
counted AS (SELECT id, doc_id, len(ts) AS n, ts FROM words WHERE len(ts) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM counted),
entries AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(ts) AS t FROM counted) GROUP BY 1, 2),
wanted AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({TERM_SQL}) AS t FROM benchmark) GROUP BY 1, 2),
weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM entries, total WHERE t IN (SELECT t FROM wanted) GROUP BY t),
scores AS (
  SELECT item_id, doc_id, id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM wanted JOIN entries USING (t) JOIN weights USING (t) JOIN counted USING (id), total
  GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _escaped_sql(text: str) -> str:
    t = f"replace({text}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        t = f"replace({t}, {_quoted(control)}, {_quoted(chat.escape(control))})"
    return t


_MARKUP_SQL = " ".join(f"WHEN {_quoted(r)} THEN {len(a) + len(b)}" for r, (a, b) in chat.MARKUP.items())

OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_quoted(PLANTED_TURN)} UNION ALL SELECT -7, 1, 'assistant', {_quoted(PLANTED_TURN)}),
said AS (
  SELECT *, length({_escaped_sql("text")})
    + CASE role {_MARKUP_SQL} ELSE length({_escaped_sql("role")}) + {sum(map(len, chat.around("")))} END AS chars
  FROM turns),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
    sum(chars)::BIGINT AS formatted_chars
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM whole
"""

OP13_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents),
draws AS (
  SELECT *, len(us) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
  FROM units),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM draws),
pieces AS (
  SELECT *, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""

ORACLE = {
    "op6_url_filter": OP6_SQL,
    "op7_license_scan": OP7_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_chat_format": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
