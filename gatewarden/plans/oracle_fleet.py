"""DuckDB oracle SQL for the settings, document, pairing, access and log bindings.

Written in the most direct SQL form of each rule (anti-joins with LIKE
prefixes, correlated subqueries, window row_number), independently of the
Spark formulation.  The fixed value tables (registry, categories, routes,
whitespace class) are rendered from :mod:`gatewarden.functions.constants`.
"""

from __future__ import annotations

from ..functions import constants as C
from ..functions.text import PY_LINE_BREAK, PY_WHITESPACE_CLASS, provider_label
from ..operators.settings import provider_keys

ORACLE: dict[str, str] = {}

WS = PY_WHITESPACE_CLASS
STRIP = f"'^[{WS}]+|[{WS}]+$'"
RSTRIP = f"'[{WS}]+$'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, {STRIP}, '', 'g')"


REGISTRY_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_q(k)}, {_q(lbl)}, {_q(cat)}, {'true' if sec else 'false'})" for i, (k, lbl, cat, sec) in enumerate(C.REGISTRY)
) + ") t(ord, key, label, category, is_secret))"

CATEGORIES_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_q(c)}, {_q(t)})" for i, (c, t) in enumerate(list(C.CATEGORIES) + [C.OTHER_CATEGORY])
) + ") t(o, category, title))"

PROVIDERS_IN = "(" + ", ".join(_q(k) for k in provider_keys()) + ")"

CUSTOMER_ENV_FILES = """
SELECT c_custkey AS deployment_id, '.env' AS path, concat_ws(chr(10),
  '# settings for ' || c_name,
  CASE WHEN c_acctbal >= 0 THEN 'LLM_MODEL=' || lower(c_mktsegment) || '/m' || CAST(c_nationkey AS VARCHAR) END,
  CASE WHEN c_nationkey < 8 THEN 'OPENROUTER_API_KEY="sk-or-' || CAST(c_custkey AS VARCHAR) || '"' END,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'HF_TOKEN=''hf_' || c_name || '''' END,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN chr(9) || 'AWS_ACCESS_KEY_ID = AKIA' || CAST(c_custkey AS VARCHAR) || '  ' END,
  CASE WHEN c_acctbal > 5000 THEN 'TELEGRAM_BOT_TOKEN=' || CAST(c_custkey AS VARCHAR) || ':tg' END,
  'WHATSAPP_ENABLED=' || CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'false' WHEN 'BUILDING' THEN 'No'
                          WHEN 'FURNITURE' THEN '0' WHEN 'HOUSEHOLD' THEN 'yes' ELSE '' END,
  CASE WHEN c_acctbal < 1000 THEN 'EMAIL_ADDRESS=' || lower(replace(c_name, '#', '.')) || '@example.com' END,
  CASE WHEN c_acctbal > 8000 THEN 'CUSTOM_PROVIDER_BASE_URL= https://' || lower(c_mktsegment) || '.example.com/v1' END,
  CASE WHEN c_acctbal > 8000 AND c_nationkey < 12 THEN 'CUSTOM_PROVIDER_NAME=' || c_name || ' ' || c_mktsegment END,
  'export EXTRA_' || CAST(c_nationkey AS VARCHAR) || '=' || CAST(c_custkey AS VARCHAR),
  CASE WHEN c_nationkey >= 20 THEN 'ADMIN_PASSWORD=pw' || CAST(c_custkey AS VARCHAR) END,
  CASE WHEN c_nationkey >= 20 THEN 'LLM_MODEL=override-' || CAST(c_custkey AS VARCHAR) END,
  'novalue',
  CASE WHEN c_mktsegment = 'FURNITURE' THEN '=' || CAST(c_nationkey AS VARCHAR) END
) AS text FROM customer
"""


def parse_sql(files: str) -> str:
    """Python .env parsing rules over a files(deployment_id, path, text) relation."""
    return f"""
SELECT deployment_id, path, line_no, key,
       CASE WHEN length(v0) >= 2 AND left(v0, 1) = right(v0, 1) AND left(v0, 1) IN ('"', '''')
            THEN substr(v0, 2, length(v0) - 2) ELSE v0 END AS value
FROM (
  SELECT deployment_id, path, CAST(line_no AS INTEGER) AS line_no,
         {_strip("split_part(line, '=', 1)")} AS key,
         {_strip("substr(line, strpos(line, '=') + 1)")} AS v0
  FROM (
    SELECT deployment_id, path, line_no, {_strip('raw')} AS line
    FROM (
      SELECT deployment_id, path, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS line_no
      FROM (SELECT deployment_id, path, string_split_regex(text, {_q(PY_LINE_BREAK)}) AS parts FROM ({files}) f0) f1
    ) f2
  ) f3
  WHERE length(line) > 0 AND NOT starts_with(line, '#') AND contains(line, '=')
) f4
"""


EFFECTIVE = f"""
SELECT deployment_id, path, key, arg_max(value, line_no) AS value
FROM ({parse_sql(CUSTOMER_ENV_FILES)}) p GROUP BY deployment_id, path, key
"""
SETTINGS = f"SELECT deployment_id, key, value FROM ({EFFECTIVE}) e"

ORACLE["parse_dotenv"] = parse_sql(
    CUSTOMER_ENV_FILES
    + " UNION ALL SELECT doc_id AS deployment_id, 'documents/' || source AS path, text FROM documents"
)
ORACLE["effective_settings"] = EFFECTIVE

ORACLE["categorise_settings"] = f"""
SELECT s.deployment_id, s.key, s.value, coalesce(r.category, 'other') AS category,
       coalesce(r.is_secret, false) AS is_secret, CAST(r.ord AS VARCHAR) AS ord
FROM ({SETTINGS}) s LEFT JOIN {REGISTRY_SQL} r ON r.key = s.key
"""

MASK_EXPR = """CASE WHEN coalesce(r.is_secret, false) AND length(s.value) > 0
            THEN CASE WHEN length(s.value) > 8 THEN left(s.value, 8) || '***' ELSE '***' END
            ELSE s.value END"""

ORACLE["mask_settings"] = f"""
SELECT s.deployment_id, s.key, {MASK_EXPR} AS value
FROM ({SETTINGS}) s LEFT JOIN {REGISTRY_SQL} r ON r.key = s.key
"""

ORACLE["apply_masked_update"] = f"""
WITH st AS ({SETTINGS}),
masked AS (
  SELECT s.deployment_id, s.key, {MASK_EXPR} AS value, c.c_nationkey
  FROM st s LEFT JOIN {REGISTRY_SQL} r ON r.key = s.key JOIN customer c ON c.c_custkey = s.deployment_id
), edited AS (
  SELECT deployment_id, key,
         CASE WHEN key = 'TELEGRAM_BOT_TOKEN' THEN ''
              WHEN key = 'LLM_MODEL' THEN value || '-v2'
              WHEN key = 'OPENROUTER_API_KEY' AND c_nationkey BETWEEN 4 AND 7 THEN 'sk-new-' || CAST(deployment_id AS VARCHAR)
              ELSE value END AS value
  FROM masked WHERE NOT starts_with(key, 'export EXTRA_')
), upd AS (
  SELECT * FROM edited
  UNION ALL SELECT c_custkey, 'GATEWAY_ALLOW_ALL_USERS', 'true' FROM customer
  UNION ALL SELECT c_custkey, 'MATRIX_USER_ID', '@u***' FROM customer
), j AS (
  SELECT coalesce(u.deployment_id, e.deployment_id) AS deployment_id, coalesce(u.key, e.key) AS key,
         u.value AS nv, e.value AS ov
  FROM upd u FULL OUTER JOIN st e ON u.deployment_id = e.deployment_id AND u.key = e.key
), m AS (
  SELECT j.deployment_id, j.key,
         CASE WHEN nv IS NOT NULL THEN
              CASE WHEN coalesce(r.is_secret, false) AND ends_with(nv, '***') THEN coalesce(ov, '') ELSE nv END
              ELSE ov END AS value
  FROM j LEFT JOIN {REGISTRY_SQL} r ON r.key = j.key
)
SELECT deployment_id, key, value FROM m WHERE length(value) > 0
"""

ORACLE["layer_settings"] = f"""
WITH layers AS (
  SELECT deployment_id, key, value, 2 AS priority FROM ({SETTINGS}) s
  UNION ALL SELECT c_custkey, 'LLM_MODEL', 'env-default', 0 FROM customer
  UNION ALL SELECT c_custkey, 'GATEWAY_HOME', '/root/.gateway', 0 FROM customer
  UNION ALL SELECT c_custkey, 'PORT', '8080', 0 FROM customer
  UNION ALL SELECT c_custkey, 'GATEWAY_HOME', '/data/.gateway', 1 FROM customer
  UNION ALL SELECT c_custkey, 'OPENROUTER_API_KEY', 'env-key-' || CAST(c_custkey AS VARCHAR), 0 FROM customer
)
SELECT deployment_id, key, arg_max(value, priority) AS value FROM layers GROUP BY deployment_id, key
"""

EMPTIED = f"""
SELECT s.deployment_id, s.key, CASE WHEN c.c_acctbal < 0 THEN '' ELSE s.value END AS value
FROM ({SETTINGS}) s JOIN customer c ON c.c_custkey = s.deployment_id
"""

ORACLE["render_dotenv"] = f"""
WITH s AS (
  SELECT s.deployment_id, coalesce(r.category, 'other') AS category, s.key || '=' || s.value AS entry
  FROM ({EMPTIED}) s LEFT JOIN {REGISTRY_SQL} r ON r.key = s.key WHERE length(s.value) > 0
), g AS (
  SELECT deployment_id, category, string_agg(entry, chr(10) ORDER BY entry) AS entries FROM s GROUP BY deployment_id, category
), b AS (
  SELECT g.deployment_id, c.o, '# ' || c.title || chr(10) || g.entries || chr(10) AS blk
  FROM g JOIN {CATEGORIES_SQL} c ON c.category = g.category
)
SELECT e.deployment_id, coalesce(t.text, '') AS text
FROM (SELECT DISTINCT deployment_id FROM ({EMPTIED}) x) e
LEFT JOIN (SELECT deployment_id, string_agg(blk, chr(10) ORDER BY o) AS text FROM b GROUP BY deployment_id) t USING (deployment_id)
"""

ORACLE["render_dotenv_lines"] = f"""
WITH s AS (
  SELECT s.deployment_id, c.o AS cat_ord, c.title, s.key || '=' || s.value AS entry
  FROM ({EMPTIED}) s LEFT JOIN {REGISTRY_SQL} r ON r.key = s.key
  JOIN {CATEGORIES_SQL} c ON c.category = coalesce(r.category, 'other')
  WHERE length(s.value) > 0
), g AS (SELECT DISTINCT deployment_id, cat_ord, title FROM s),
l AS (SELECT deployment_id, max(cat_ord) AS last_ord FROM g GROUP BY deployment_id)
SELECT deployment_id, cat_ord, 0 AS part, '# ' || title AS line FROM g
UNION ALL SELECT deployment_id, cat_ord, 1 AS part, entry AS line FROM s
UNION ALL SELECT g.deployment_id, g.cat_ord, 2 AS part, '' AS line FROM g JOIN l ON l.deployment_id = g.deployment_id
          WHERE g.cat_ord <> l.last_ord
UNION ALL SELECT deployment_id, 0, 2, '' FROM (SELECT DISTINCT deployment_id FROM ({EMPTIED}) x) e
          WHERE deployment_id NOT IN (SELECT deployment_id FROM s)
"""

CUSTOMER_DOCS = """
SELECT c_custkey AS deployment_id,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' AND c_acctbal < 0
         THEN '{"providers": {"xai-oauth": {"tokens": {"refresh_token": 0}}}}'
       WHEN c_mktsegment = 'AUTOMOBILE'
         THEN '{"providers": {"xai-oauth": {"tokens": {"refresh_token": "r' || CAST(c_custkey AS VARCHAR)
              || '"}, "auth_mode": "oauth_device"}, "other": {"tokens": {}}}, "active_provider": "xai-oauth", "version": 2}'
       WHEN c_mktsegment = 'BUILDING'
         THEN '{"providers": {"xai-oauth": {"tokens": {"access_token": "a"}}}, "active_provider": "other"}'
       WHEN c_mktsegment = 'FURNITURE' THEN 'not json {'
       WHEN c_mktsegment = 'HOUSEHOLD' THEN '{"providers": {"xai-oauth": {"tokens": "oops"}}}'
       ELSE '{"providers": {"xai-oauth": {"tokens": {"refresh_token": ""}}, "p' || CAST(c_nationkey AS VARCHAR)
            || '": {"tokens": {"refresh_token": "x"}}}, "active_provider": "p' || CAST(c_nationkey AS VARCHAR) || '"}'
  END AS doc
FROM customer
"""

REFRESH = f"""
WITH docs AS ({CUSTOMER_DOCS}),
v AS (SELECT deployment_id, doc FROM docs WHERE json_valid(doc)),
t AS (SELECT deployment_id, json_extract(doc, '$.providers."xai-oauth".tokens') AS tk FROM v),
r AS (SELECT deployment_id, CASE WHEN json_type(tk) = 'OBJECT' THEN json_extract(tk, '$.refresh_token') END AS rt FROM t),
p AS (
  SELECT deployment_id,
    CASE json_type(rt)
      WHEN 'VARCHAR' THEN length(json_extract_string(rt, '$')) > 0
      WHEN 'BOOLEAN' THEN json_extract_string(rt, '$') = 'true'
      WHEN 'OBJECT' THEN CAST(rt AS VARCHAR) <> '{{}}'
      WHEN 'ARRAY' THEN json_array_length(rt) > 0
      WHEN 'NULL' THEN false
      ELSE TRY_CAST(json_extract_string(rt, '$') AS DOUBLE) <> 0 END AS h
  FROM r
)
SELECT d.deployment_id, coalesce(p.h, false) AS has_refresh_token FROM docs d LEFT JOIN p ON p.deployment_id = d.deployment_id
"""
ORACLE["credential_presence"] = REFRESH

READINESS = f"""
WITH per AS (
  SELECT deployment_id, bool_or(key = 'LLM_MODEL' AND length(value) > 0) AS hm,
         bool_or(key IN {PROVIDERS_IN} AND length(value) > 0) AS hp
  FROM ({SETTINGS}) s GROUP BY deployment_id
), rt AS ({REFRESH})
SELECT c.c_custkey AS deployment_id, coalesce(per.hm, false) AS has_model,
       coalesce(per.hp, false) OR coalesce(rt.has_refresh_token, false) AS has_provider,
       coalesce(per.hm, false) AND (coalesce(per.hp, false) OR coalesce(rt.has_refresh_token, false)) AS ready
FROM customer c LEFT JOIN per ON per.deployment_id = c.c_custkey LEFT JOIN rt ON rt.deployment_id = c.c_custkey
"""
ORACLE["readiness"] = READINESS

ORACLE["first_configured"] = f"""
SELECT s.deployment_id, arg_min(s.key, r.ord) AS key, arg_min(s.value, r.ord) AS value
FROM ({SETTINGS}) s JOIN {REGISTRY_SQL} r ON r.key = s.key
WHERE r.category = 'provider' AND length(s.value) > 0
GROUP BY s.deployment_id
"""

_CATALOGUE = [("provider", provider_label(k), k) for k in provider_keys()] + [("channel", n, k) for n, k in C.CHANNELS]
CATALOGUE_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({_q(a)}, {_q(b)}, {_q(c)})" for a, b, c in _CATALOGUE) + ") t(kind, name, skey))"

ORACLE["integration_status"] = f"""
SELECT c.c_custkey AS deployment_id, cat.kind, cat.name,
       CASE WHEN cat.kind = 'channel'
            THEN coalesce(length(s.value) > 0 AND lower(s.value) NOT IN ('false', '0', 'no'), false)
            ELSE coalesce(length(s.value) > 0, false) END AS configured
FROM customer c CROSS JOIN {CATALOGUE_SQL} cat
LEFT JOIN ({SETTINGS}) s ON s.deployment_id = c.c_custkey AND s.key = cat.skey
"""

_STATUS_ROWS = f"""
SELECT c.c_custkey AS deployment_id, cat.kind, cat.skey,
       CASE WHEN cat.kind = 'channel'
            THEN coalesce(length(s.value) > 0 AND lower(s.value) NOT IN ('false', '0', 'no'), false)
            ELSE coalesce(length(s.value) > 0, false) END AS configured
FROM customer c CROSS JOIN {CATALOGUE_SQL} cat
LEFT JOIN ({SETTINGS}) s ON s.deployment_id = c.c_custkey AND s.key = cat.skey
"""
ORACLE["integration_matrix"] = (
    "SELECT deployment_id, "
    + ", ".join(
        f"bool_or(configured) FILTER (WHERE kind = {_q(kind)} AND skey = {_q(skey)}) AS {kind}_{skey.lower()}"
        for kind, _, skey in _CATALOGUE
    )
    + f" FROM ({_STATUS_ROWS}) r GROUP BY deployment_id"
)

ORACLE["custom_endpoints"] = f"""
WITH p AS (
  SELECT deployment_id, max(CASE WHEN key = 'CUSTOM_PROVIDER_BASE_URL' THEN value END) AS url,
         max(CASE WHEN key = 'CUSTOM_PROVIDER_NAME' THEN value END) AS nm
  FROM ({SETTINGS}) s GROUP BY deployment_id
), q AS (
  SELECT deployment_id, {_strip("coalesce(url, '')")} AS u, {_strip("coalesce(nm, '')")} AS n FROM p
)
SELECT deployment_id,
       coalesce(nullif(regexp_replace(regexp_replace(lower(CASE WHEN n <> '' THEN n ELSE u END), '[^a-z0-9-]', '-', 'g'),
                                      '^-+|-+$', '', 'g'), ''), 'custom') AS name,
       u AS base_url, 'CUSTOM_PROVIDER_API_KEY' AS key_env
FROM q WHERE length(u) > 0
"""

_PART_LEAVES = """
  SELECT p_partkey AS d, 'model.default' AS path, p_name AS value, 'str' AS vt FROM part WHERE p_type <> 'ECONOMY'
  UNION ALL SELECT p_partkey, 'model.provider', lower(p_brand), 'str' FROM part WHERE p_type <> 'ECONOMY'
  UNION ALL SELECT p_partkey, 'model', 'gpt-x', 'str' FROM part WHERE p_type = 'ECONOMY'
  UNION ALL SELECT p_partkey, 'terminal', 'docker', 'str' FROM part WHERE p_type = 'SMALL'
  UNION ALL SELECT p_partkey, 'terminal.backend', 'docker', 'str' FROM part WHERE p_type <> 'SMALL'
  UNION ALL SELECT p_partkey, 'terminal.shell', 'bash', 'str' FROM part WHERE p_type <> 'SMALL'
  UNION ALL SELECT p_partkey, 'agent.max_iterations', CASE WHEN p_size <= 45 THEN CAST(p_size AS VARCHAR) END, 'int' FROM part WHERE p_size > 40
  UNION ALL SELECT p_partkey, 'agent.max_iterations.soft', CAST(p_size AS VARCHAR), 'int' FROM part WHERE p_size < 5
  UNION ALL SELECT p_partkey, 'mcp_servers.' || lower(replace(p_brand, '#', '')), 'run-' || CAST(p_partkey AS VARCHAR), 'str' FROM part
  UNION ALL SELECT p_partkey, 'custom_providers', '[]', 'list' FROM part WHERE p_type = 'PROMO'
  UNION ALL SELECT p_partkey, 'custom_providers.0.name', 'old', 'str' FROM part WHERE p_type = 'LARGE'
  UNION ALL SELECT p_partkey, 'data_dir.sub', 'x', 'str' FROM part WHERE p_type = 'MEDIUM'
"""

_PART_POLICY = """
  SELECT p_partkey AS d, 'model.default' AS path, lower(p_name) AS value, 'force' AS policy, 'str' AS vt FROM part
  UNION ALL SELECT p_partkey, 'model.provider', 'auto', 'force', 'str' FROM part WHERE p_size <= 25
  UNION ALL SELECT p_partkey, 'terminal.backend', 'local', 'force', 'str' FROM part
  UNION ALL SELECT p_partkey, 'terminal.timeout', '60', 'force', 'int' FROM part
  UNION ALL SELECT p_partkey, 'terminal.cwd', '/tmp', 'force', 'str' FROM part
  UNION ALL SELECT p_partkey, 'agent.max_iterations', '50', 'default', 'int' FROM part
  UNION ALL SELECT p_partkey, 'data_dir', '/data/.gateway', 'force', 'str' FROM part
  UNION ALL SELECT p_partkey, 'custom_providers', '[{"name": "' || lower(replace(p_brand, '#', '-')) || '"}]', 'force', 'list'
            FROM part WHERE p_retailprice > 950
  UNION ALL SELECT p_partkey, 'custom_providers', NULL, 'remove', 'list' FROM part WHERE p_retailprice <= 950
"""

PROVIDER_DOCS = f"""
SELECT d.deployment_id,
  CASE c.c_nationkey WHEN 5 THEN '{{"providers": [], "active_provider": "xai-oauth"}}'
       WHEN 6 THEN '{{"providers": null, "active_provider": "xai-oauth", "version": 1}}'
       WHEN 7 THEN '{{"active_provider": "xai-oauth", "note": {{}}}}' ELSE d.doc END AS doc
FROM ({CUSTOMER_DOCS}) d JOIN customer c ON c.c_custkey = d.deployment_id
"""

# Leaves of the documents: scalars and empty containers; a text that is no object is its own leaf.
PROVIDER_LEAVES = f"""
SELECT d.deployment_id, t.fullkey AS path0, replace(replace(t.fullkey, '"', ''), '$.', '$.') AS path,
       CASE WHEN t.type = 'NULL' THEN NULL WHEN t.type IN ('OBJECT', 'ARRAY') THEN CAST(t.value AS VARCHAR)
            ELSE json_extract_string(t.value, '$') END AS value,
       json_type(d.doc, '$.providers') AS pt, json_extract_string(d.doc, '$.active_provider') AS ap
FROM (SELECT * FROM ({PROVIDER_DOCS}) x WHERE json_valid(doc) AND json_type(doc) = 'OBJECT') d, json_tree(d.doc) t
WHERE t.type NOT IN ('OBJECT', 'ARRAY') OR CAST(t.value AS VARCHAR) IN ('{{}}', '[]')
"""
_NOT_OBJECTS = f"SELECT deployment_id, '$' AS path, doc AS value FROM ({PROVIDER_DOCS}) x WHERE NOT json_valid(doc)"

ORACLE["remove_provider"] = f"""
WITH l AS ({PROVIDER_LEAVES}),
gone AS (SELECT * FROM l WHERE (pt IS NULL OR pt = 'OBJECT')
           AND (starts_with(path, '$.providers.xai-oauth') OR (path = '$.active_provider' AND ap = 'xai-oauth'))),
emptied AS (
  SELECT d.deployment_id FROM ({PROVIDER_DOCS}) d
  WHERE json_valid(doc) AND json_type(CASE WHEN json_valid(doc) THEN doc END, '$.providers') = 'OBJECT'
    AND json_keys(CASE WHEN json_valid(doc) THEN doc END, '$.providers') = ['xai-oauth'])
SELECT deployment_id, path, value FROM l
WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.deployment_id = l.deployment_id AND g.path = l.path)
UNION ALL SELECT deployment_id, '$.providers', '{{}}' FROM emptied
UNION ALL {_NOT_OBJECTS}
"""

ORACLE["upsert_provider"] = f"""
WITH l AS ({PROVIDER_LEAVES}),
kept AS (
  SELECT deployment_id, path, value FROM l
  WHERE NOT starts_with(path, '$.providers.xai-oauth') AND path NOT IN ('$.active_provider', '$.version', '$.updated_at')
    AND NOT (path = '$.providers'))
SELECT * FROM kept
UNION ALL SELECT c_custkey, unnest(['$.providers.xai-oauth.tokens.access_token', '$.providers.xai-oauth.tokens.refresh_token',
    '$.providers.xai-oauth.auth_mode', '$.providers.xai-oauth.last_refresh', '$.providers.xai-oauth.redirect_uri',
    '$.providers.xai-oauth.discovery.authorization_endpoint', '$.providers.xai-oauth.discovery.token_endpoint',
    '$.active_provider', '$.version', '$.updated_at']),
  unnest(['at-' || CAST(c_custkey AS VARCHAR), 'rt-' || CAST(c_custkey AS VARCHAR), 'oauth_device', '2024-01-31T00:00:00Z', '',
    'https://auth.example.com/authorize', 'https://auth.example.com/token', 'xai-oauth', '2', '2024-01-31T00:00:00Z'])
FROM customer
"""

ORACLE["inject_html"] = """
SELECT page_id, hit AS injected,
       md5(CASE WHEN hit THEN substr(html, 1, strpos(html, '</body>') - 1)
                             || '<div id="back-widget"><a href="/setup">Setup</a></div>' || substr(html, strpos(html, '</body>'))
                ELSE html END) AS html_md5,
       CAST(length(html) + CASE WHEN hit THEN length('<div id="back-widget"><a href="/setup">Setup</a></div>') ELSE 0 END AS BIGINT) AS html_len
FROM (SELECT *, NOT ends_with(url, '#top') AND contains(html, '</body>') AS hit FROM pages) p
"""

PAIRING_FILES = """
SELECT o_custkey AS deployment_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'telegram-pending.json' WHEN '2-HIGH' THEN 'discord-pending.json'
       WHEN '3-MEDIUM' THEN 'my-pending-pending.json' WHEN '4-NOT SPECIFIED' THEN 'slack-approved.json'
       ELSE 'whatsapp-pending.json' END AS name,
  CASE WHEN o_orderstatus = 'P' THEN '{"broken": '
       ELSE '{"e' || CAST(o_orderkey AS VARCHAR) || '": {"user_id": "' || CAST(o_custkey AS VARCHAR) || '", "user_name": "c'
            || CAST(o_custkey AS VARCHAR) || '", "created_at": ' || CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR)
            || '}, "k' || CAST(o_orderkey AS VARCHAR) || '": {"user_id": ' || CAST(o_custkey AS VARCHAR) || '}'
            || CASE WHEN o_orderstatus = 'F' THEN ', "x' || CAST(o_orderkey AS VARCHAR) || '": "oops"}' ELSE '}' END END AS text
FROM orders
"""

ORACLE["read_keyed_json"] = f"""
WITH f AS (
  SELECT deployment_id, name, regexp_extract(name, '^(.*)-pending\\.json$', 1) AS platform, text
  FROM ({PAIRING_FILES}) x WHERE regexp_matches(name, '-pending\\.json$')
), ok AS (SELECT * FROM f WHERE json_valid(text) AND json_type(text) = 'OBJECT'),
e AS (SELECT deployment_id, platform, text, unnest(json_keys(text)) AS entry_key FROM ok)
SELECT deployment_id, platform, entry_key,
       json_extract_string(text, '$."' || entry_key || '".user_id') AS user_id,
       json_extract_string(text, '$."' || entry_key || '".user_name') AS user_name,
       CAST(CAST(TRY_CAST(json_extract_string(text, '$."' || entry_key || '".created_at') AS DOUBLE) AS BIGINT) AS VARCHAR) AS created_at
FROM e
"""

ORACLE["read_keyed_json_corrupt"] = f"""
WITH f AS (SELECT deployment_id, name, text FROM ({PAIRING_FILES}) x WHERE regexp_matches(name, '-pending\\.json$')),
ok AS (SELECT * FROM f WHERE json_valid(text) AND json_type(text) = 'OBJECT'),
e AS (SELECT deployment_id, name, text, unnest(json_keys(text)) AS entry_key FROM ok)
SELECT deployment_id, name, NULL AS entry_key FROM f WHERE NOT (json_valid(text) AND json_type(CASE WHEN json_valid(text) THEN text END) = 'OBJECT')
UNION ALL SELECT deployment_id, name, entry_key FROM e WHERE json_type(text, '$."' || entry_key || '"') <> 'OBJECT'
"""

PLATFORM_SQL = "CASE WHEN {v} < 10 THEN 'telegram' WHEN {v} < 30 THEN 'discord' ELSE 'slack' END"

ORACLE["pending_requests"] = f"""
SELECT user_id AS deployment_id, {PLATFORM_SQL.format(v='value')} AS platform, CAST(event_id AS VARCHAR) AS code,
       CASE WHEN value < 5 THEN '  ' ELSE CAST(user_id AS VARCHAR) END AS user_id,
       'user-' || CAST(user_id AS VARCHAR) AS user_name,
       CAST(trunc((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 60000000.0) AS BIGINT) AS age_minutes
FROM events
WHERE event_type = 'signup' AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) <= 86400000000
"""

DECISIONS_CTE = f"""
pend AS (
  SELECT user_id AS deployment_id, {PLATFORM_SQL.format(v='value')} AS platform, CAST(event_id AS VARCHAR) AS code,
         CASE WHEN value < 5 THEN '' ELSE CAST(user_id AS VARCHAR) END AS uid
  FROM events WHERE event_type = 'signup'
), dec AS (
  SELECT l.l_orderkey * 8 + l.l_linenumber AS decision_id, coalesce(e.user_id, -1) AS deployment_id,
         l.l_shipdate AS ts, l.l_orderkey * 8 + l.l_linenumber AS seq,
         CASE WHEN l.l_linestatus = 'O' AND l.l_returnflag = 'A' THEN NULL
              WHEN l.l_returnflag = 'R' THEN 'deny' ELSE 'approve' END AS op,
         CASE WHEN l.l_linenumber = 6 THEN '' ELSE coalesce({PLATFORM_SQL.format(v='e.value')}, 'telegram') END AS platform,
         CAST(l.l_orderkey AS VARCHAR) AS code
  FROM lineitem l LEFT JOIN events e ON e.event_id = l.l_orderkey
), dj AS (
  SELECT d.*, p.uid,
         (d.op IS NULL) OR (d.op = 'approve' AND (d.platform = '' OR d.code = '')) AS bad
  FROM dec d LEFT JOIN pend p ON p.deployment_id = d.deployment_id AND p.platform = d.platform AND p.code = d.code
), eff AS (
  SELECT deployment_id, platform, code, ts, seq,
         row_number() OVER (PARTITION BY deployment_id, platform, code ORDER BY ts, seq) AS rn
  FROM dj WHERE NOT bad AND (op = 'deny' OR (op = 'approve' AND uid IS NOT NULL AND length(uid) > 0))
), f AS (SELECT deployment_id, platform, code, ts AS fts, seq AS fseq FROM eff WHERE rn = 1)
"""

ORACLE["resolve_decisions"] = f"""
WITH {DECISIONS_CTE}
SELECT dj.decision_id,
       CAST(CASE WHEN bad THEN 400 WHEN op = 'deny' THEN 200
                 WHEN uid IS NULL OR (f.fts IS NOT NULL AND (dj.ts > f.fts OR (dj.ts = f.fts AND dj.seq > f.fseq))) THEN 404
                 WHEN length(uid) = 0 THEN 422 ELSE 200 END AS BIGINT) AS status
FROM dj LEFT JOIN f ON f.deployment_id = dj.deployment_id AND f.platform = dj.platform AND f.code = dj.code
"""

ORACLE["resolve_decisions_remaining"] = f"""
WITH {DECISIONS_CTE}
SELECT p.deployment_id, p.platform, p.code FROM pend p
WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.deployment_id = p.deployment_id AND f.platform = p.platform AND f.code = p.code)
"""

ORACLE["publish_pairing_state"] = f"""
SELECT user_id AS deployment_id, {PLATFORM_SQL.format(v='value')} AS platform, CAST(event_id AS VARCHAR) AS code,
       CASE WHEN value < 5 THEN '  ' ELSE CAST(user_id AS VARCHAR) END AS user_id, 'user-' || CAST(user_id AS VARCHAR) AS user_name
FROM events WHERE event_type = 'signup' AND (user_id % 3 <> 0 OR value >= 20)
"""

ORACLE["approved_users"] = """
WITH ops AS (
  SELECT user_id AS deployment_id, 'telegram' AS platform, CAST(user_id AS VARCHAR) AS uid, event_type,
         'user-' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) AS uname, ts, event_id AS seq
  FROM events WHERE event_type IN ('signup', 'error')
), l AS (
  SELECT *, row_number() OVER (PARTITION BY deployment_id, platform, uid ORDER BY ts DESC, seq DESC) AS rn FROM ops
)
SELECT deployment_id, platform, uid AS user_id, uname AS user_name, epoch_us(ts) AS approved_at_us
FROM l WHERE rn = 1 AND event_type = 'signup'
"""

ORACLE["scrub_headers"] = """
SELECT deployment_id, seq, header, value FROM (
  SELECT user_id AS deployment_id, event_id AS seq, 'Host' AS header, 'gw-' || CAST(user_id AS VARCHAR) AS value FROM events
  UNION ALL SELECT user_id, event_id, 'Transfer-Encoding', 'chunked' FROM events
  UNION ALL SELECT user_id, event_id, 'Accept', CASE WHEN value > 25 THEN 'text/html' ELSE 'application/json' END FROM events
  UNION ALL SELECT user_id, event_id, 'X-Request-Id', CAST(event_id AS VARCHAR) FROM events
  UNION ALL SELECT user_id, event_id, 'TRANSFER-ENCODING', CASE WHEN value > 40 THEN 'gzip' END FROM events
) h WHERE lower(header) NOT IN ('host', 'transfer-encoding')
"""


def _routes_sql() -> str:
    rows = []
    for i, (kind, pat, methods, handler) in enumerate(C.ROUTES):
        ms = set(methods or ("GET",))
        if "GET" in ms:
            ms.add("HEAD")
        mtype = "prefix" if pat.endswith("{path:path}") else "exact"
        p = pat[: -len("{path:path}")] if mtype == "prefix" else pat
        mlist = "[" + ", ".join(_q(m) for m in sorted(ms)) + "]"
        rows.append(f"({i}, {_q(kind)}, {_q(p)}, {_q(mtype)}, {mlist}, {_q(handler)})")
    return "(SELECT * FROM (VALUES " + ", ".join(rows) + ") t(idx, kind, pat, mtype, methods, handler))"


ROUTES_SQL = _routes_sql()
PUBLIC_IN = "(" + ", ".join(_q(h) for h in C.PUBLIC_HANDLERS) + ")"


def classify_sql(req: str, keys: str) -> str:
    """First full route match, else first path match (405), else not_found; over req(keys..., method, path, kind)."""
    return f"""
WITH req AS ({req}),
m AS (
  SELECT {', '.join('r.' + k for k in keys.split(', '))}, t.idx,
         (t.kind = 'ws' OR list_contains(t.methods, upper(r.method))) AS full_match
  FROM req r JOIN {ROUTES_SQL} t ON t.kind = r.kind
   AND (CASE WHEN t.mtype = 'exact' THEN r.path = t.pat ELSE starts_with(r.path, t.pat) END)
), best AS (
  SELECT {keys}, min(idx) FILTER (WHERE full_match) AS fidx, min(idx) AS pidx FROM m GROUP BY {keys}
)
SELECT r.*,
       CASE WHEN b.fidx IS NOT NULL THEN tf.handler
            WHEN b.pidx IS NOT NULL AND r.kind = 'http' THEN 'method_not_allowed' ELSE 'not_found' END AS handler,
       CAST(coalesce(b.fidx, CASE WHEN r.kind = 'http' THEN b.pidx END) AS BIGINT) AS route_index,
       coalesce(tf.handler IN {PUBLIC_IN}, false) AS is_public
FROM req r LEFT JOIN best b USING ({keys}) LEFT JOIN {ROUTES_SQL} tf ON tf.idx = b.fidx
"""


PAGE_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
PAGE_REQUESTS = f"""
SELECT page_id, CASE regexp_extract(path, '^/([a-z]+)/', 1) WHEN 'en' THEN 'GET' WHEN 'fr' THEN 'POST'
                     WHEN 'es' THEN 'PUT' ELSE 'TRACE' END AS method, variant, kind, p AS path
FROM (
  SELECT page_id, path, unnest([1, 2, 3, 4, 5]) AS variant, unnest(['http', 'http', 'http', 'ws', 'http']) AS kind,
         unnest([path, '/setup' || path, '/setup/api/' || regexp_extract(path, '([^/]*)/?$', 1), '/api/plugins' || path, '/']) AS p
  FROM (SELECT page_id, {PAGE_PATH} AS path FROM pages) x
) y
"""

ORACLE["classify_routes"] = f"""
SELECT page_id, variant, method, path, handler, route_index, is_public
FROM ({classify_sql(PAGE_REQUESTS, 'page_id, variant')}) c
"""

ORACLE["classify_routes_by_table"] = f"""
WITH rules AS (
  SELECT page_id % 10 AS dep, page_id + CASE WHEN page_id % 7 = 0 THEN 1000000 ELSE 0 END AS priority,
         page_id % 7 < 4 AS open, CASE WHEN page_id % 7 = 0 THEN regexp_extract(path, '^(.*/)', 1) WHEN page_id % 7 < 4 THEN path[:-2] ELSE path END AS pat,
         CASE page_id % 3 WHEN 0 THEN ['POST', 'PUT'] ELSE ['GET', 'HEAD'] END AS methods, 'h' || page_id AS handler
  FROM (SELECT page_id, {PAGE_PATH} AS path FROM pages) x
), m AS (
  SELECT r.page_id, r.variant, t.priority, t.handler, list_contains(t.methods, r.method) AS ok
  FROM ({PAGE_REQUESTS}) r JOIN rules t ON t.dep = r.page_id % 10 AND r.kind = 'http'
   AND (CASE WHEN t.open THEN starts_with(r.path, t.pat) ELSE r.path = t.pat END)
), best AS (
  SELECT page_id, variant, arg_min(handler, priority) FILTER (WHERE ok) AS handler, min(priority) FILTER (WHERE ok) AS fp, min(priority) AS pp
  FROM m GROUP BY page_id, variant
)
SELECT r.page_id, r.variant, CASE WHEN b.fp IS NOT NULL THEN b.handler WHEN b.pp IS NOT NULL THEN 'method_not_allowed' ELSE 'not_found' END AS handler,
       CAST(coalesce(b.fp, b.pp) AS VARCHAR) AS route_index
FROM ({PAGE_REQUESTS}) r LEFT JOIN best b USING (page_id, variant)
"""

SESSION_SQL = """
WITH acc AS (
  SELECT user_id AS deployment_id, event_id AS seq, ts, event_type, value FROM events WHERE event_type IN ('view', 'click', 'purchase')
), lg AS (SELECT user_id AS deployment_id, ts FROM events WHERE event_type = 'signup'),
bt AS (SELECT user_id AS deployment_id, ts FROM events WHERE event_type = 'error'),
a2 AS (
  SELECT a.*,
         (SELECT max(epoch_us(l.ts)) FROM lg l WHERE l.deployment_id = a.deployment_id AND l.ts <= a.ts) AS login_us,
         (SELECT max(epoch_us(b.ts)) FROM bt b WHERE b.deployment_id = a.deployment_id AND b.ts <= a.ts) AS boot_us
  FROM acc a
)
SELECT deployment_id, seq, ts, event_type, value, epoch_us(ts) AS ts_us, login_us,
       coalesce(login_us IS NOT NULL AND (boot_us IS NULL OR login_us >= boot_us)
                AND epoch_us(ts) <= (login_us // 1000000 + 172800) * 1000000, false) AS valid
FROM a2
"""

ORACLE["session_validity"] = f"SELECT deployment_id, seq, ts_us, CAST(login_us AS VARCHAR) AS login_us, valid FROM ({SESSION_SQL}) s"

ORACLE["safe_return_target"] = f"""
WITH v AS (
  SELECT page_id, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS variant,
         unnest([path || CASE WHEN q <> '' THEN '?' || q ELSE '' END, url, '//' || host || path, '', '/\\' || host,
                 '/' || chr(9) || '/' || host, '/' || chr(10) || '/' || host, '/' || chr(13) || '/' || host,
                 '/' || chr(9) || '//' || host]) AS rt
  FROM (SELECT page_id, url, {PAGE_PATH} AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q,
               regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) x
), h AS (SELECT *, replace(replace(replace(rt, chr(9), ''), chr(10), ''), chr(13), '') AS bare FROM v),
b AS (SELECT *, (length(rt) = 0 OR NOT starts_with(rt, '/') OR starts_with(rt, '//')
                 OR (starts_with(bare, '//') AND length(bare) > 2 AND substr(bare, 3, 1) NOT IN ('/', '?', '#'))) AS bad FROM h)
SELECT page_id, variant, CASE WHEN bad THEN '/' ELSE rt END AS target, bad AS was_rejected, contains(rt, '\\') AS has_backslash
FROM b
"""

EVENT_REQUESTS = """
SELECT user_id AS deployment_id, event_id AS seq,
       CASE WHEN event_type = 'view' AND value > 45 THEN 'TRACE' WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
       CASE WHEN event_type = 'view' AND value > 45 THEN '/health' WHEN event_type = 'view' THEN '/'
            WHEN event_type = 'click' AND value < 5 THEN '/api/ws' WHEN event_type = 'click' AND value < 8 THEN '/nowhere'
            WHEN event_type = 'click' THEN '/setup/api/status' ELSE '/api/chat' END AS path,
       CASE WHEN value > 40 THEN 'force=1' WHEN value > 30 THEN 'a=b c' ELSE '' END AS query,
       value > 25 AS wants_html, CASE WHEN event_type = 'click' AND value < 8 THEN 'ws' ELSE 'http' END AS kind
FROM events WHERE event_type IN ('view', 'click', 'purchase')
"""

ORACLE["access_decision"] = f"""
WITH c AS ({classify_sql(EVENT_REQUESTS, 'deployment_id, seq')}),
s AS ({SESSION_SQL}),
r AS ({READINESS}),
j AS (
  SELECT c.*, s.valid, coalesce(r.ready, false) AS ready FROM c JOIN s ON s.deployment_id = c.deployment_id AND s.seq = c.seq
  LEFT JOIN r ON r.deployment_id = c.deployment_id
), d AS (
  SELECT *, CASE WHEN handler IN ('method_not_allowed', 'not_found') THEN handler
                 WHEN is_public THEN 'pass' WHEN kind = 'ws' AND NOT valid THEN 'close_ws'
                 WHEN NOT valid AND wants_html THEN 'redirect_login'
                 WHEN NOT valid THEN 'unauthorized'
                 WHEN handler = 'route_root' AND method = 'GET' AND query <> 'force=1' AND NOT ready THEN 'redirect_setup'
                 ELSE 'handler' END AS decision
  FROM j
)
SELECT deployment_id, seq, handler, decision,
       CAST(CASE WHEN decision IN ('redirect_login', 'redirect_setup') THEN 302 WHEN decision = 'unauthorized' THEN 401
                 WHEN decision = 'close_ws' THEN 4401 WHEN handler = 'method_not_allowed' THEN 405
                 WHEN kind = 'http' AND handler IN ('route_setup_404', 'not_found') THEN 404 END AS VARCHAR) AS status,
       CASE WHEN decision = 'redirect_login'
            THEN '/login?returnTo=' || replace(replace(replace(path || CASE WHEN query <> '' THEN '?' || query ELSE '' END,
                                                               '?', '%3F'), '=', '%3D'), ' ', '%20')
            WHEN decision = 'redirect_setup' THEN '/setup' END AS location
FROM d
"""

ORACLE["upstream_errors"] = """
WITH r AS (
  SELECT doc_id AS deployment_id,
         CASE lang WHEN 'de' THEN 404 WHEN 'fr' THEN 500 WHEN 'es' THEN 399 ELSE 200 END AS st,
         CASE source WHEN 'src3' THEN 'connect' WHEN 'src7' THEN 'other' END AS failure, text
  FROM documents
), f AS (SELECT *, left(text, 200) AS t200 FROM r WHERE failure IS NOT NULL OR st >= 400),
k AS (SELECT *, list_max(list_filter(range(0, 201), lambda i: strlen(left(t200, i)) <= 200)) AS nk FROM f)
SELECT deployment_id,
       CAST(CASE WHEN failure = 'connect' THEN 503 WHEN failure IS NOT NULL THEN 502 ELSE st END AS BIGINT) AS status,
       CASE WHEN failure = 'connect' THEN 'unavailable' WHEN failure IS NOT NULL THEN 'upstream_error' ELSE 'error_status' END AS outcome,
       CASE WHEN failure IS NULL THEN left(t200, nk)
            || CASE WHEN strlen(left(t200, nk)) < 200 AND strlen(text) > strlen(left(t200, nk)) THEN chr(65533) ELSE '' END END AS snippet
FROM k
"""

LOG_LINES = f"""
SELECT deployment_id, seq, regexp_replace(regexp_replace(raw, {RSTRIP}, ''), '\\x1b\\[[0-9;]*m', '', 'g') AS line FROM (
  SELECT user_id AS deployment_id, event_id AS seq,
    CASE event_type
      WHEN 'view' THEN chr(27) || '[36m[dashboard]' || chr(27) || '[0m GET /en/' || CAST(event_id AS VARCHAR) || ' 200   '
                       || CASE WHEN value > 45 THEN chr(65533) ELSE '' END
      WHEN 'click' THEN '[gateway] model=m' || CAST(user_id AS VARCHAR) || ' | provider_key=set'
      WHEN 'error' THEN chr(27) || '[31m[gateway] exited (code ' || json_extract_string(props, '$.k') || ') — supervising restart  '
                        || chr(27) || '[0m'
      WHEN 'purchase' THEN '[proxy] POST /api/chat -> '
                           || CASE WHEN value > 250 THEN '502' WHEN value > 100 THEN '500' ELSE '404' END || ' body=''{{"e": 1}}''   '
      ELSE '[gateway] restarting in ' || CASE WHEN value > 20 THEN '400000'
           ELSE CAST(CAST(least(2 * pow(2, floor(value / 100)), 30) AS INTEGER) AS VARCHAR) END
           || 's (attempt ' || CAST(CAST(floor(value / 100) + 1 AS INTEGER) AS VARCHAR) || ')' || chr(9)
    END AS raw
  FROM events
) e
"""

ORACLE["clean_log_lines"] = LOG_LINES

ORACLE["extract_lifecycle_events"] = f"""
WITH l AS ({LOG_LINES}),
t AS (
  SELECT *, CASE
      WHEN regexp_matches(line, '^\\[gateway\\] exited \\(code (-?\\d+|None)\\) — supervising restart') THEN 'exit'
      WHEN regexp_matches(line, '^\\[gateway\\] restarting in (\\d+)s \\(attempt (\\d+)\\)') THEN 'respawn_scheduled'
      WHEN regexp_matches(line, '^\\[gateway\\] model=.* \\| provider_key=') THEN 'start'
      WHEN regexp_matches(line, '^\\[proxy\\] (\\S+) (\\S*) -> (\\d+) body=') THEN 'upstream_status'
    END AS event
  FROM l
)
SELECT deployment_id, seq, event,
       CAST(CASE WHEN event = 'exit' THEN TRY_CAST(regexp_extract(line, '\\(code (-?\\d+)\\)', 1) AS BIGINT) END AS VARCHAR) AS exit_code,
       CAST(CASE WHEN event = 'respawn_scheduled' THEN TRY_CAST(regexp_extract(line, 'restarting in (\\d+)s', 1) AS BIGINT) END AS VARCHAR) AS delay_s,
       CAST(CASE WHEN event = 'respawn_scheduled' THEN TRY_CAST(regexp_extract(line, 'attempt (\\d+)', 1) AS BIGINT) END AS VARCHAR) AS attempt,
       CASE WHEN event = 'upstream_status' THEN regexp_extract(line, '^\\[proxy\\] (\\S+) ', 1) END AS method,
       CASE WHEN event = 'upstream_status' THEN regexp_extract(line, '^\\[proxy\\] \\S+ (\\S*) ->', 1) END AS path,
       CAST(CASE WHEN event = 'upstream_status' THEN TRY_CAST(regexp_extract(line, ' -> (\\d+) ', 1) AS BIGINT) END AS VARCHAR) AS status
FROM t WHERE event IS NOT NULL
"""


def overlay_sql(ex: str, pol: str) -> str:
    """O10 over leaves ex(d, path, value, vt) and a policy pol(d, path, value, policy, vt)."""
    return f"""
WITH ex AS ({ex}), pol AS ({pol})
SELECT d AS deployment_id, path, value, vt AS value_type FROM ex e
WHERE NOT EXISTS (SELECT 1 FROM pol c WHERE c.d = e.d AND c.policy IN ('force', 'remove') AND (e.path = c.path OR starts_with(e.path, c.path || '.')))
  AND NOT EXISTS (SELECT 1 FROM pol c WHERE c.d = e.d AND c.policy IN ('force', 'default') AND starts_with(c.path, e.path || '.'))
UNION ALL SELECT d, path, value, vt FROM pol WHERE policy = 'force'
UNION ALL SELECT d, path, value, vt FROM pol c WHERE policy = 'default'
  AND NOT EXISTS (SELECT 1 FROM ex e WHERE e.d = c.d AND (e.path = c.path OR starts_with(e.path, c.path || '.')))
"""


ORACLE["overlay_config"] = overlay_sql(_PART_LEAVES, _PART_POLICY)

_SIGN_INS = "SELECT p_partkey AS d, CASE WHEN p_size >= 25 THEN lower(p_brand) ELSE '' END AS model FROM part"

ORACLE["overlay_sign_in"] = overlay_sql(_PART_LEAVES, f"""
  SELECT d, 'model.default' AS path, model AS value, 'force' AS policy, 'str' AS vt FROM ({_SIGN_INS}) s WHERE model <> ''
  UNION ALL SELECT d, unnest(['model.provider', 'data_dir']), unnest(['xai-oauth', '/data/.gateway']), 'force', 'str' FROM ({_SIGN_INS}) s
  UNION ALL SELECT d, unnest(['terminal.backend', 'terminal.timeout', 'terminal.cwd', 'agent.max_iterations']),
    unnest(['local', '60', '/tmp', '50']), 'default', unnest(['str', 'int', 'str', 'int']) FROM ({_SIGN_INS}) s
""")

ORACLE["sign_in_settings"] = f"""
SELECT d AS deployment_id, unnest(['LLM_MODEL', '_MODEL_XAI_OAUTH']) AS key, model AS value FROM ({_SIGN_INS}) s WHERE model <> ''
"""


_CUSTOMER_LEAVES = """
  SELECT c_custkey AS d, 'model.default' AS path, 'old-' || lower(c_mktsegment) AS value, 'str' AS vt FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT c_custkey, 'model', 'legacy', 'str' FROM customer WHERE c_acctbal <= 0
  UNION ALL SELECT c_custkey, 'model.provider', 'xai-oauth', 'str' FROM customer WHERE c_nationkey >= 15 AND c_acctbal > 0
  UNION ALL SELECT c_custkey, 'terminal.backend', 'docker', 'str' FROM customer
  UNION ALL SELECT c_custkey, 'terminal.shell', 'zsh', 'str' FROM customer
  UNION ALL SELECT c_custkey, 'agent.max_iterations', CASE WHEN c_nationkey < 20 THEN CAST(c_nationkey * 10 AS VARCHAR) END, 'int' FROM customer WHERE c_nationkey > 10
  UNION ALL SELECT c_custkey, 'mcp_servers.fs.command', 'npx fs-' || CAST(c_custkey AS VARCHAR), 'str' FROM customer
  UNION ALL SELECT c_custkey, 'custom_providers', '[]', 'list' FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
"""

_SETTINGS_POLICY = f"""
  WITH per AS (
    SELECT deployment_id AS d, max(CASE WHEN key = 'LLM_MODEL' THEN value END) AS model,
           bool_or(key IN {PROVIDERS_IN} AND length(value) > 0) AS anyp
    FROM (SELECT * FROM ({SETTINGS}) s0 WHERE deployment_id % 4 <> 0 UNION ALL SELECT c_custkey, '', '' FROM customer) s GROUP BY deployment_id
  ), ce AS (
    SELECT deployment_id AS d, '[{{"name":"' || name || '","base_url":"' || base_url || '","key_env":"' || key_env || '"}}]' AS cj
    FROM ({ORACLE["custom_endpoints"]}) x WHERE deployment_id % 4 <> 0
  ), p AS (SELECT per.*, ce.cj FROM per LEFT JOIN ce ON ce.d = per.d)
  SELECT d, 'model.default' AS path, coalesce(model, '') AS value, 'force' AS policy, 'str' AS vt FROM p
  UNION ALL SELECT d, 'model.provider', 'auto', 'force', 'str' FROM p WHERE coalesce(anyp, false)
  UNION ALL SELECT d, 'terminal.backend', 'local', 'force', 'str' FROM p
  UNION ALL SELECT d, 'terminal.timeout', '60', 'force', 'int' FROM p
  UNION ALL SELECT d, 'terminal.cwd', '/tmp', 'force', 'str' FROM p
  UNION ALL SELECT d, 'agent.max_iterations', '50', 'default', 'int' FROM p
  UNION ALL SELECT d, 'data_dir', '/data/.gateway', 'force', 'str' FROM p
  UNION ALL SELECT d, 'custom_providers', cj, CASE WHEN cj IS NOT NULL THEN 'force' ELSE 'remove' END, 'list' FROM p
"""

ORACLE["overlay_from_settings"] = overlay_sql(_CUSTOMER_LEAVES, _SETTINGS_POLICY)
