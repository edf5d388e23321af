"""

Every stand-in is a pure projection / join of whole driver tables, so its
size grows with the scale factor.  The same derivations are spelled in SQL in
:mod:`gatewarden.plans.oracle` and :mod:`gatewarden.plans.oracle_fleet`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import credential_presence
from ..operators.settings import effective_settings
from ..sources.dotenv import parse_dotenv
from .tables import table

AS_OF = "2024-01-31 00:00:00"


def _s(c: Column) -> Column:
    return c.cast("string")


# ---------------------------------------------------------------------------
# Settings: one .env file per customer (deployment_id = c_custkey)
# ---------------------------------------------------------------------------


def customer_env_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey", "c_name"])
    seg, bal, nk, ck, name = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_nationkey"), _s(F.col("c_custkey")), F.col("c_name")
    whatsapp = (
        F.when(seg == "AUTOMOBILE", "false")
        .when(seg == "BUILDING", "No")
        .when(seg == "FURNITURE", "0")
        .when(seg == "HOUSEHOLD", "yes")
        .otherwise("")
    )
    lines = [
        F.concat(F.lit("# settings for "), name),
        F.when(bal >= 0, F.concat(F.lit("LLM_MODEL="), F.lower(seg), F.lit("/m"), _s(nk))),
        F.when(nk < 8, F.concat(F.lit('OPENROUTER_API_KEY="sk-or-'), ck, F.lit('"'))),
        F.when(seg == "BUILDING", F.concat(F.lit("HF_TOKEN='hf_"), name, F.lit("'"))),
        F.when(seg == "MACHINERY", F.concat(F.lit("\tAWS_ACCESS_KEY_ID = AKIA"), ck, F.lit("  "))),
        F.when(bal > 5000, F.concat(F.lit("TELEGRAM_BOT_TOKEN="), ck, F.lit(":tg"))),
        F.concat(F.lit("WHATSAPP_ENABLED="), whatsapp),
        F.when(bal < 1000, F.concat(F.lit("EMAIL_ADDRESS="), F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@example.com"))),
        F.when(bal > 8000, F.concat(F.lit("CUSTOM_PROVIDER_BASE_URL= https://"), F.lower(seg), F.lit(".example.com/v1"))),
        F.when((bal > 8000) & (nk < 12), F.concat(F.lit("CUSTOM_PROVIDER_NAME="), name, F.lit(" "), seg)),
        F.concat(F.lit("export EXTRA_"), _s(nk), F.lit("="), ck),
        F.when(nk >= 20, F.concat(F.lit("ADMIN_PASSWORD=pw"), ck)),
        F.when(nk >= 20, F.concat(F.lit("LLM_MODEL=override-"), ck)),
        F.lit("novalue"),
        F.when(seg == "FURNITURE", F.concat(F.lit("="), _s(nk))),
    ]
    return c.select(
        F.col("c_custkey").alias("deployment_id"), F.lit(".env").alias("path"), F.concat_ws("\n", *lines).alias("text")
    )


def customer_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective settings (dep, key, value) of the customer .env files."""
    parsed = parse_dotenv(customer_env_files(spark, sf_dir))
    return effective_settings(parsed).select("deployment_id", "key", "value")


def emptied_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings after the customers with a negative balance cleared all values."""
    bal = table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"]).withColumnRenamed("c_custkey", "deployment_id")
    s = customer_settings(spark, sf_dir).join(bal, "deployment_id")
    return s.select("deployment_id", "key", F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("value")).alias("value"))


def provider_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The credential documents, some with ``providers`` of a wrong type."""
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]).withColumnRenamed("c_custkey", "deployment_id")
    d = customer_credential_docs(spark, sf_dir).join(c, "deployment_id")
    wrong = F.when(F.col("c_nationkey") == 5, F.lit('{"providers": [], "active_provider": "xai-oauth"}')).when(
        F.col("c_nationkey") == 6, F.lit('{"providers": null, "active_provider": "xai-oauth", "version": 1}')
    ).when(F.col("c_nationkey") == 7, F.lit('{"active_provider": "xai-oauth", "note": {}}'))
    return d.select("deployment_id", F.coalesce(wrong, F.col("doc")).alias("doc"))


def customer_credential_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey"])
    seg, bal, nk, ck = F.col("c_mktsegment"), F.col("c_acctbal"), _s(F.col("c_nationkey")), _s(F.col("c_custkey"))
    doc = (
        F.when(
            (seg == "AUTOMOBILE") & (bal < 0),
            F.lit('{"providers": {"xai-oauth": {"tokens": {"refresh_token": 0}}}}'),
        )
        .when(
            seg == "AUTOMOBILE",
            F.concat(
                F.lit('{"providers": {"xai-oauth": {"tokens": {"refresh_token": "r'),
                ck,
                F.lit('"}, "auth_mode": "oauth_device"}, "other": {"tokens": {}}}, "active_provider": "xai-oauth", "version": 2}'),
            ),
        )
        .when(seg == "BUILDING", F.lit('{"providers": {"xai-oauth": {"tokens": {"access_token": "a"}}}, "active_provider": "other"}'))
        .when(seg == "FURNITURE", F.lit("not json {"))
        .when(seg == "HOUSEHOLD", F.lit('{"providers": {"xai-oauth": {"tokens": "oops"}}}'))
        .otherwise(
            F.concat(
                F.lit('{"providers": {"xai-oauth": {"tokens": {"refresh_token": ""}}, "p'),
                nk,
                F.lit('": {"tokens": {"refresh_token": "x"}}}, "active_provider": "p'),
                nk,
                F.lit('"}'),
            )
        )
    )
    return c.select(F.col("c_custkey").alias("deployment_id"), doc.alias("doc"))


def customer_refresh_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_presence(customer_credential_docs(spark, sf_dir))


def customer_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("deployment_id"))


# ---------------------------------------------------------------------------
# Pairing: pending requests = signup events (deployment_id = user_id)
# ---------------------------------------------------------------------------


def platform_of_value(v: Column) -> Column:
    return F.when(v < 10, "telegram").when(v < 30, "discord").otherwise("slack")


def pending_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    return ev.select(
        F.col("user_id").alias("deployment_id"),
        platform_of_value(F.col("value")).alias("platform"),
        _s(F.col("event_id")).alias("code"),
        F.when(F.col("value") < 5, F.lit("  ")).otherwise(_s(F.col("user_id"))).alias("user_id"),
        F.concat(F.lit("user-"), _s(F.col("user_id"))).alias("user_name"),
        F.col("ts").alias("created_at"),
    )


def decisions_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions: one per lineitem row on code = l_orderkey (several per code).

    The deciding deployment and platform are those of the event with that id
    (when one exists), so decisions hit real pending codes; deny when the line
    was returned (R).  Padded codes (5-LOW orders' lines are not known here,
    so: line number 7) test the strip; an unreadable body (null op) when the
    line status is O and the flag is A; a missing platform for line number 6.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("l_orderkey"), "user_id", "value")
    j = li.join(ev, on="l_orderkey", how="left")
    code = _s(F.col("l_orderkey"))
    return j.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("decision_id"),
        F.coalesce(F.col("user_id"), F.lit(-1).cast("bigint")).alias("deployment_id"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), F.lit(None).cast("string"))
        .when(F.col("l_returnflag") == "R", F.lit("deny"))
        .otherwise(F.lit("approve"))
        .alias("op"),
        F.when(F.col("l_linenumber") == 6, F.lit("")).otherwise(
            F.coalesce(platform_of_value(F.col("value")), F.lit("telegram"))
        ).alias("platform"),
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit(" "), code, F.lit(" "))).otherwise(code).alias("code"),
    )


# ---------------------------------------------------------------------------
# Access log: events as requests; pages as paths
# ---------------------------------------------------------------------------

URL_PATH_RE = r"^https?://[^/?#]+([^?#]*)"
URL_QUERY_RE = r"\?([^#]*)"
URL_HOST_RE = r"^https?://([^/?#]+)"


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five requests per page: its path, a /setup typo, a /setup/api path,
    a WebSocket plugin path and the root; the method follows the language
    segment of the path (en GET, fr POST, es PUT, other TRACE)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    path = F.regexp_extract("url", URL_PATH_RE, 1)
    lang = F.regexp_extract(path, r"^/([a-z]+)/", 1)
    method = F.when(lang == "en", "GET").when(lang == "fr", "POST").when(lang == "es", "PUT").otherwise("TRACE")
    last_seg = F.regexp_extract(path, r"([^/]*)/?$", 1)
    reqs = F.array(
        F.struct(F.lit(1).alias("variant"), F.lit("http").alias("kind"), path.alias("path")),
        F.struct(F.lit(2).alias("variant"), F.lit("http").alias("kind"), F.concat(F.lit("/setup"), path).alias("path")),
        F.struct(F.lit(3).alias("variant"), F.lit("http").alias("kind"), F.concat(F.lit("/setup/api/"), last_seg).alias("path")),
        F.struct(F.lit(4).alias("variant"), F.lit("ws").alias("kind"), F.concat(F.lit("/api/plugins"), path).alias("path")),
        F.struct(F.lit(5).alias("variant"), F.lit("http").alias("kind"), F.lit("/").alias("path")),
    )
    return p.select("page_id", method.alias("method"), F.explode(reqs).alias("r")).select("page_id", "method", "r.*")


def event_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view/click/purchase events as requests of their user's session."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click", "purchase"))
    et = F.col("event_type")
    return ev.select(
        F.col("user_id").alias("deployment_id"),
        _s(F.col("user_id")).alias("session_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when((et == "view") & (F.col("value") > 45), "TRACE").when(et == "purchase", "POST").otherwise("GET").alias("method"),
        F.when((et == "view") & (F.col("value") > 45), "/health")
        .when(et == "view", "/")
        .when((et == "click") & (F.col("value") < 5), "/api/ws")
        .when((et == "click") & (F.col("value") < 8), "/nowhere")
        .when(et == "click", "/setup/api/status")
        .otherwise("/api/chat")
        .alias("path"),
        F.when((et == "click") & (F.col("value") < 8), "ws").otherwise("http").alias("kind"),
        F.when(F.col("value") > 40, "force=1").when(F.col("value") > 30, "a=b c").otherwise("").alias("query"),
        F.when(F.col("value") > 25, "text/html,application/xhtml+xml").otherwise("application/json").alias("accept"),
    )


def event_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    return ev.select(F.col("user_id").alias("deployment_id"), _s(F.col("user_id")).alias("session_id"), "ts")


def event_boots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return ev.select(F.col("user_id").alias("deployment_id"), "ts")


# ---------------------------------------------------------------------------
# Logs: events rendered as supervisor / child output lines
# ---------------------------------------------------------------------------

ESC = "\x1b"


def event_log_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    et, v, uid, eid = F.col("event_type"), F.col("value"), _s(F.col("user_id")), _s(F.col("event_id"))
    k = F.get_json_object("props", "$.k")
    attempt = (F.floor(v / 100) + 1).cast("int")
    # Long delays for some, so that starts fall into the backoff.
    delay = F.when(v > 20, F.lit(400000)).otherwise(F.least(F.lit(2) * F.pow(F.lit(2), attempt - 1), F.lit(30)).cast("int"))
    status = F.when(v > 250, 502).when(v > 100, 500).otherwise(404)
    text = (
        F.when(et == "view", F.concat(F.lit(ESC + "[36m[dashboard]" + ESC + "[0m GET /en/"), eid, F.lit(" 200   ")))
        .when(et == "click", F.concat(F.lit("[gateway] model=m"), uid, F.lit(" | provider_key=set")))
        .when(et == "error", F.concat(F.lit(ESC + "[31m[gateway] exited (code "), k, F.lit(") — supervising restart  " + ESC + "[0m")))
        .when(et == "purchase", F.concat(F.lit("[proxy] POST /api/chat -> "), _s(status), F.lit(" body='{\"e\": 1}'   ")))
        .otherwise(F.concat(F.lit("[gateway] restarting in "), _s(delay), F.lit("s (attempt "), _s(attempt), F.lit(")\t")))
    )
    raw = F.encode(text, "UTF-8")
    raw = F.when((et == "view") & (v > 45), F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    return ev.select(
        F.col("user_id").alias("deployment_id"),
        F.lit("gateway").alias("source"),
        "ts",
        F.col("event_id").alias("seq"),
        raw.alias("bytes"),
    )
