"""Stand-in bindings of the settings, document, pairing, access and log jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import access as A
from ..operators import documents as D
from ..operators import pairing as P
from ..operators import settings as S
from ..operators.scans import micros
from ..sources.dotenv import parse_dotenv
from ..sources.keyed_json import read_keyed_json
from ..sources.logs import clean_log_lines, extract_lifecycle_events
from ..session import shared_folder
from ..sources.sinks import publish_pairing_state, read_published
from . import standins as X
from .bindings import query
from .tables import table

# ---------------------------------------------------------------------------
# Settings (O1, O4, O7, O11-O15, O18, O25, O28)
# ---------------------------------------------------------------------------


@query("parse_dotenv")
def parse_dotenv_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 over the customer .env files and the whole text of every document."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "text"]).select(
        F.col("doc_id").alias("deployment_id"), F.concat(F.lit("documents/"), "source").alias("path"), "text"
    )
    files = X.customer_env_files(spark, sf_dir).unionByName(docs)
    return parse_dotenv(files)


@query("effective_settings")
def effective_settings_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last line wins per (dep, path, key)."""
    return S.effective_settings(parse_dotenv(X.customer_env_files(spark, sf_dir)))


@query("categorise_settings")
def categorise_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry category (other for unknown keys), secret flag, registry order."""
    out = S.categorise_settings(X.customer_settings(spark, sf_dir))
    return out.withColumn("ord", F.col("ord").cast("string"))


@query("mask_settings")
def mask_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked view of the settings."""
    return S.mask_settings(X.customer_settings(spark, sf_dir))


@query("apply_masked_update")
def masked_update_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UI round trip — the masked settings come back with edits:
    EXTRA_* keys omitted (carried over), the Telegram token cleared (deleted),
    the model renamed, a new OpenRouter key for nations 4-7, two new keys
    (one a non-secret ending in ***)."""
    existing = X.customer_settings(spark, sf_dir)
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("deployment_id"), "c_nationkey")
    masked = S.mask_settings(existing).join(cust, on="deployment_id", how="inner")
    k = F.col("key")
    edited = masked.filter(~k.startswith("export EXTRA_")).select(
        "deployment_id",
        "key",
        F.when(k == "TELEGRAM_BOT_TOKEN", F.lit(""))
        .when(k == "LLM_MODEL", F.concat("value", F.lit("-v2")))
        .when((k == "OPENROUTER_API_KEY") & F.col("c_nationkey").between(4, 7), F.concat(F.lit("sk-new-"), F.col("deployment_id").cast("string")))
        .otherwise(F.col("value"))
        .alias("value"),
    )
    added = cust.select(
        "deployment_id",
        F.explode(
            F.array(
                F.struct(F.lit("GATEWAY_ALLOW_ALL_USERS").alias("key"), F.lit("true").alias("value")),
                F.struct(F.lit("MATRIX_USER_ID").alias("key"), F.lit("@u***").alias("value")),
            )
        ).alias("kv"),
    ).select("deployment_id", "kv.key", "kv.value")
    return S.apply_masked_update(edited.unionByName(added), existing)


@query("layer_settings")
def layer_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process env (0) < fixed home value (1) < the .env file (2)."""
    file_layer = X.customer_settings(spark, sf_dir).withColumn("priority", F.lit(2))
    c = table(spark, sf_dir, "customer")
    env = c.select(
        F.col("c_custkey").alias("deployment_id"),
        F.explode(
            F.array(
                F.struct(F.lit("LLM_MODEL").alias("key"), F.lit("env-default").alias("value"), F.lit(0).alias("priority")),
                F.struct(F.lit("GATEWAY_HOME").alias("key"), F.lit("/root/.gateway").alias("value"), F.lit(0).alias("priority")),
                F.struct(F.lit("PORT").alias("key"), F.lit("8080").alias("value"), F.lit(0).alias("priority")),
                F.struct(F.lit("GATEWAY_HOME").alias("key"), F.lit("/data/.gateway").alias("value"), F.lit(1).alias("priority")),
                F.struct(
                    F.lit("OPENROUTER_API_KEY").alias("key"),
                    F.concat(F.lit("env-key-"), F.col("c_custkey").cast("string")).alias("value"),
                    F.lit(0).alias("priority"),
                ),
            )
        ).alias("kv"),
    ).select("deployment_id", "kv.*")
    return S.layer_settings(env.unionByName(file_layer))


@query("render_dotenv")
def render_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered .env text per deployment, some of them emptied."""
    return S.render_dotenv(X.emptied_settings(spark, sf_dir))


@query("render_dotenv_lines")
def render_lines_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4, line form (what the file sink writes): header, entries, blank line."""
    return S.render_dotenv_lines(X.emptied_settings(spark, sf_dir))


@query("readiness")
def readiness_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model AND (provider key OR refresh token), every customer listed."""
    return S.readiness(
        X.customer_deployments(spark, sf_dir), X.customer_settings(spark, sf_dir), X.customer_refresh_tokens(spark, sf_dir)
    )


@query("first_configured")
def first_configured_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First non-empty provider key in registry order."""
    return S.first_configured(X.customer_settings(spark, sf_dir))


@query("integration_status")
def integration_status_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every provider and channel per deployment."""
    return S.integration_status(X.customer_deployments(spark, sf_dir), X.customer_settings(spark, sf_dir))


@query("integration_matrix")
def integration_matrix_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O25 pivoted: one boolean column per provider and channel."""
    return S.integration_matrix(X.customer_deployments(spark, sf_dir), X.customer_settings(spark, sf_dir))


@query("custom_endpoints")
def custom_endpoints_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom endpoint rows with slug names."""
    return S.custom_endpoints(X.customer_settings(spark, sf_dir))


# ---------------------------------------------------------------------------
# Documents
# ---------------------------------------------------------------------------


def part_config_leaves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    t, size, brand, price, pk = F.col("p_type"), F.col("p_size"), F.col("p_brand"), F.col("p_retailprice"), F.col("p_partkey").cast("string")

    def leaf(path, value, vtype, cond=None):
        s = F.struct(path.alias("path") if not isinstance(path, str) else F.lit(path).alias("path"), value.cast("string").alias("value"), F.lit(vtype).alias("value_type"))
        return s if cond is None else F.when(cond, s)

    leaves = F.array(
        leaf("model.default", F.col("p_name"), "str", t != "ECONOMY"),
        leaf("model.provider", F.lower(brand), "str", t != "ECONOMY"),
        leaf("model", F.lit("gpt-x"), "str", t == "ECONOMY"),
        leaf("terminal", F.lit("docker"), "str", t == "SMALL"),
        leaf("terminal.backend", F.lit("docker"), "str", t != "SMALL"),
        leaf("terminal.shell", F.lit("bash"), "str", t != "SMALL"),
        leaf("agent.max_iterations", F.when(size <= 45, size), "int", size > 40),
        leaf("agent.max_iterations.soft", size, "int", size < 5),
        leaf(F.concat(F.lit("mcp_servers."), F.lower(F.replace(brand, F.lit("#"), F.lit("")))), F.concat(F.lit("run-"), pk), "str"),
        leaf("custom_providers", F.lit("[]"), "list", t == "PROMO"),
        leaf("custom_providers.0.name", F.lit("old"), "str", t == "LARGE"),
        leaf("data_dir.sub", F.lit("x"), "str", t == "MEDIUM"),
    )
    existing = p.select(F.col("p_partkey").alias("deployment_id"), F.explode(leaves).alias("l")).filter(
        F.col("l").isNotNull()
    ).select("deployment_id", "l.*")

    def pol(path, value, policy, vtype, cond=None):
        s = F.struct(F.lit(path).alias("path"), value.cast("string").alias("value"), F.lit(policy).alias("policy"), F.lit(vtype).alias("value_type"))
        return s if cond is None else F.when(cond, s)

    custom = F.concat(F.lit('[{"name": "'), F.lower(F.replace(brand, F.lit("#"), F.lit("-"))), F.lit('"}]'))
    policies = F.array(
        pol("model.default", F.lower(F.col("p_name")), "force", "str"),
        pol("model.provider", F.lit("auto"), "force", "str", size <= 25),
        *[pol(path, F.lit(v), "force", "int" if v.isdigit() else "str") for path, v in C.TERMINAL_DEFAULTS],
        pol("agent.max_iterations", F.lit(str(C.DEFAULT_MAX_ITERATIONS)), "default", "int"),
        pol("data_dir", F.lit("/data/.gateway"), "force", "str"),
        pol("custom_providers", custom, "force", "list", price > 950),
        pol("custom_providers", F.lit(None), "remove", "list", price <= 950),
    )
    policy = p.select(F.col("p_partkey").alias("deployment_id"), F.explode(policies).alias("l")).filter(
        F.col("l").isNotNull()
    ).select("deployment_id", "l.*")
    return existing, policy


@query("overlay_config")
def overlay_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Config leaves of every part overlaid with the boot policy."""
    existing, policy = part_config_leaves(spark, sf_dir)
    return D.overlay_config(existing, policy)


@query("overlay_from_settings")
def overlay_from_settings_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O10 with the boot policy derived from each customer's settings (model,
    provider-key presence, custom endpoint) over customer-derived config leaves."""
    c = table(spark, sf_dir, "customer")
    seg, bal, nk, ck = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey").cast("string")

    def leaf(path, value, vtype, cond=None):
        st = F.struct(F.lit(path).alias("path"), value.cast("string").alias("value"), F.lit(vtype).alias("value_type"))
        return st if cond is None else F.when(cond, st)

    leaves = F.array(
        leaf("model.default", F.concat(F.lit("old-"), F.lower(seg)), "str", bal > 0),
        leaf("model", F.lit("legacy"), "str", bal <= 0),
        leaf("model.provider", F.lit("xai-oauth"), "str", (nk >= 15) & (bal > 0)),
        leaf("terminal.backend", F.lit("docker"), "str"),
        leaf("terminal.shell", F.lit("zsh"), "str"),
        leaf("agent.max_iterations", F.when(nk < 20, nk * 10), "int", nk > 10),
        leaf("mcp_servers.fs.command", F.concat(F.lit("npx fs-"), ck), "str"),
        leaf("custom_providers", F.lit("[]"), "list", seg == "AUTOMOBILE"),
    )
    existing = c.select(F.col("c_custkey").alias("deployment_id"), F.explode(leaves).alias("l")).filter(
        F.col("l").isNotNull()
    ).select("deployment_id", "l.*")
    has = F.col("deployment_id") % 4 != 0  # every fourth customer has no settings at all
    policy = D.overlay_policy_from_settings(
        X.customer_settings(spark, sf_dir).filter(has), "/data/.gateway", deployments=X.customer_deployments(spark, sf_dir)
    )
    return D.overlay_config(existing, policy)


@query("overlay_sign_in")
def overlay_sign_in_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O10 with the sign-in policy: every part signs in, those of size 25 and more with a model."""
    existing, _ = part_config_leaves(spark, sf_dir)
    p = table(spark, sf_dir, "part", ["p_partkey", "p_size", "p_brand"])
    model = F.when(F.col("p_size") >= 25, F.lower("p_brand")).otherwise(F.lit(""))
    sign_ins = p.select(F.col("p_partkey").alias("deployment_id"), model.alias("model"))
    return D.overlay_config(existing, D.overlay_policy_from_sign_ins(sign_ins, "xai-oauth", "/data/.gateway"))


@query("sign_in_settings")
def sign_in_settings_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O10, settings side: what the sign-ins with a model write back."""
    p = table(spark, sf_dir, "part", ["p_partkey", "p_size", "p_brand"])
    model = F.when(F.col("p_size") >= 25, F.lower("p_brand")).otherwise(F.lit(""))
    return D.sign_in_settings(p.select(F.col("p_partkey").alias("deployment_id"), model.alias("model")), "xai-oauth")


@query("credential_presence")
def credential_presence_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refresh-token presence per credential document."""
    return X.customer_refresh_tokens(spark, sf_dir)


@query("remove_provider")
def remove_provider_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove the device-flow provider from every credential document; all leaves."""
    return D.document_leaves(D.remove_provider(X.provider_docs(spark, sf_dir), "xai-oauth"))


@query("upsert_provider")
def upsert_provider_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store fresh device-flow tokens, with a nested discovery block, in every credential document; all leaves."""
    docs = X.provider_docs(spark, sf_dir)
    tokens = F.struct(
        F.concat(F.lit("at-"), F.col("deployment_id").cast("string")).alias("access_token"),
        F.concat(F.lit("rt-"), F.col("deployment_id").cast("string")).alias("refresh_token"),
    )
    discovery = {"authorization_endpoint": "https://auth.example.com/authorize", "token_endpoint": "https://auth.example.com/token"}
    out = D.upsert_provider(docs, "xai-oauth", tokens, F.lit(X.AS_OF).cast("timestamp"), extra={"discovery": discovery})
    return D.document_leaves(out)


@query("inject_html")
def inject_html_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widget injected before the first closing body tag of HTML pages."""
    pages = table(spark, sf_dir, "pages").withColumn(
        "content_type", F.when(F.col("url").endswith("#top"), "application/json").otherwise("Text/HTML; charset=utf-8")
    )
    out = D.inject_html(pages, '<div id="back-widget"><a href="/setup">Setup</a></div>', content_type="content_type")
    return out.select("page_id", "injected", F.md5("html").alias("html_md5"), F.length("html").cast("bigint").alias("html_len"))


# ---------------------------------------------------------------------------
# Pairing (O2, O8, O16, O17)
# ---------------------------------------------------------------------------


def order_pairing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])
    pr = F.col("o_orderpriority")
    name = (
        F.when(pr == "1-URGENT", "telegram-pending.json")
        .when(pr == "2-HIGH", "discord-pending.json")
        .when(pr == "3-MEDIUM", "my-pending-pending.json")
        .when(pr == "4-NOT SPECIFIED", "slack-approved.json")
        .otherwise("whatsapp-pending.json")
    )
    ok, ck = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    created = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")
    text = F.when(F.col("o_orderstatus") == "P", F.lit('{"broken": ')).otherwise(
        F.concat(
            F.lit('{"e'), ok, F.lit('": {"user_id": "'), ck, F.lit('", "user_name": "c'), ck,
            F.lit('", "created_at": '), created, F.lit('}, "k'), ok, F.lit('": {"user_id": '), ck, F.lit("}"),
            F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(', "x'), ok, F.lit('": "oops"}'))).otherwise(F.lit("}")),
        )
    )
    return o.select(F.col("o_custkey").alias("deployment_id"), name.alias("name"), text.alias("text"))


@query("read_keyed_json")
def read_keyed_json_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: entries of every *-pending.json file."""
    entries, _ = read_keyed_json(order_pairing_files(spark, sf_dir), "pending")
    return entries.select(
        "deployment_id", "platform", "entry_key", "user_id", "user_name",
        F.col("created_at").cast("bigint").cast("string").alias("created_at"),
    )


@query("read_keyed_json_corrupt")
def read_keyed_json_corrupt_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2 side output: pending files that are not a JSON object, entries that are none."""
    _, corrupt = read_keyed_json(order_pairing_files(spark, sf_dir), "pending")
    return corrupt


@query("pending_requests")
def pending_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending requests visible at 2024-01-31 with a one-day TTL."""
    return P.pending_requests(X.pending_from_events(spark, sf_dir), X.AS_OF, ttl_s=86400)


@query("resolve_decisions")
def resolve_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every lineitem decision against the signup requests."""
    outcomes, _, _ = P.resolve_decisions(X.pending_from_events(spark, sf_dir), X.decisions_from_lineitem(spark, sf_dir))
    return outcomes.select("decision_id", F.col("status").cast("bigint").alias("status"))


@query("resolve_decisions_remaining")
def resolve_remaining_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending requests left after the decisions."""
    _, remaining, _ = P.resolve_decisions(X.pending_from_events(spark, sf_dir), X.decisions_from_lineitem(spark, sf_dir))
    return remaining.select("deployment_id", "platform", "code")


@query("publish_pairing_state")
def publish_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5, written and read back: all deployments publish, then a third of them publish
    their requests of value 20 and more (their telegram requests all go); the others'
    rows stay as they were."""
    before = X.pending_from_events(spark, sf_dir)
    published = table(spark, sf_dir, "events", ["user_id"]).select(F.col("user_id").alias("deployment_id")).filter("deployment_id % 3 = 0")
    now = before.join(
        table(spark, sf_dir, "events", ["event_id", "value"]).select(F.col("event_id").cast("string").alias("code"), "value"), "code"
    ).filter("value >= 20")
    root, none = shared_folder(spark, "pairing-state"), before.limit(0)
    publish_pairing_state(before, none, before, root)
    publish_pairing_state(now.select(before.columns), none, published, root)
    return read_published(spark, root, "pending").select("deployment_id", "platform", "code", "user_id", "user_name")


@query("approved_users")
def approved_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """approve = signup, revoke = error; latest op per user wins."""
    ev = table(spark, sf_dir, "events")
    base = ev.select(
        F.col("user_id").alias("deployment_id"),
        F.lit("telegram").alias("platform"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("user_name"),
        "ts",
        F.col("event_id").alias("seq"),
        "event_type",
    )
    res = P.approved_users(base.filter(F.col("event_type") == "signup"), base.filter(F.col("event_type") == "error"))
    return res.select("deployment_id", "platform", "user_id", "user_name", micros("approved_at").alias("approved_at_us"))


# ---------------------------------------------------------------------------
# Access (O9, O27, O29, O30, O35, O36)
# ---------------------------------------------------------------------------


@query("scrub_headers")
def scrub_headers_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hop-by-hop request headers removed, names compared in lower case."""
    ev = table(spark, sf_dir, "events")
    headers = F.create_map(
        F.lit("Host"), F.concat(F.lit("gw-"), F.col("user_id").cast("string")),
        F.lit("Transfer-Encoding"), F.lit("chunked"),
        F.lit("Accept"), F.when(F.col("value") > 25, "text/html").otherwise("application/json"),
        F.lit("X-Request-Id"), F.col("event_id").cast("string"),
        F.lit("TRANSFER-ENCODING"), F.when(F.col("value") > 40, "gzip"),
    )
    acc = ev.select(F.col("user_id").alias("deployment_id"), F.col("event_id").alias("seq"), headers.alias("headers"))
    out = A.scrub_headers(acc)
    return out.select("deployment_id", "seq", F.explode("headers").alias("header", "value"))


@query("classify_routes")
def classify_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five requests per page against the route table."""
    out = A.classify_routes(X.page_requests(spark, sf_dir))
    return out.select("page_id", "variant", "method", "path", "handler", F.col("route_index").cast("bigint"), "is_public")


@query("classify_routes_by_table")
def classify_by_table_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O27 with a rules table: ten deployments with a rule for each of their pages (its
    path, everything below its folder, or everything that begins like it), first page
    first; five requests per page."""
    p = table(spark, sf_dir, "pages", ["page_id", "url"])
    path = F.regexp_extract("url", X.URL_PATH_RE, 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    rest = F.lit("{path:path}")
    some = F.substring(path, F.lit(1), F.char_length(path) - 1)
    rules = p.select(
        (F.col("page_id") % 10).alias("deployment_id"),
        # Wide rules come after narrow ones.
        (F.col("page_id") + F.when(F.col("page_id") % 7 == 0, 1_000_000).otherwise(0)).alias("priority"),
        F.lit("http").alias("kind"),
        F.when(F.col("page_id") % 7 == 0, F.concat(folder, rest)).when(F.col("page_id") % 7 < 4, F.concat(some, rest)).otherwise(path).alias("pattern"),
        F.when(F.col("page_id") % 3 == 0, F.array(F.lit("POST"), F.lit("PUT"))).when(F.col("page_id") % 3 == 1, F.array(F.lit("GET"))).alias("methods"),
        F.concat(F.lit("h"), F.col("page_id")).alias("handler"),
    )
    requests = X.page_requests(spark, sf_dir).withColumn("deployment_id", F.col("page_id") % 10)
    out = A.classify_routes_by_table(requests, rules)
    return out.select("page_id", "variant", "handler", F.col("route_index").cast("string").alias("route_index"))


@query("session_validity")
def session_validity_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """login = signup, request = view/click/purchase, boot = error, 2-day lifetime."""
    out = A.session_validity(
        X.event_access(spark, sf_dir), X.event_logins(spark, sf_dir), X.event_boots(spark, sf_dir), lifetime_s=2 * 86400
    )
    return out.select(
        "deployment_id", "seq", micros("ts").alias("ts_us"), micros("login_ts").cast("string").alias("login_us"), "valid"
    )


@query("safe_return_target")
def safe_return_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine return targets per page URL (relative, absolute, //host, empty,
    /\\host, and a tab, LF or CR hiding a host or an empty host)."""
    p = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", X.URL_PATH_RE, 1)
    q = F.regexp_extract("url", X.URL_QUERY_RE, 1)
    host = F.regexp_extract("url", X.URL_HOST_RE, 1)
    rel = F.concat(path, F.when(F.length(q) > 0, F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    variants = F.array(
        F.struct(F.lit(1).alias("variant"), rel.alias("return_to")),
        F.struct(F.lit(2).alias("variant"), F.col("url").alias("return_to")),
        F.struct(F.lit(3).alias("variant"), F.concat(F.lit("//"), host, path).alias("return_to")),
        F.struct(F.lit(4).alias("variant"), F.lit("").alias("return_to")),
        F.struct(F.lit(5).alias("variant"), F.concat(F.lit("/\\"), host).alias("return_to")),
        *[F.struct(F.lit(i).alias("variant"), F.concat(F.lit(f"/{c}/"), host).alias("return_to")) for i, c in ((6, "\t"), (7, "\n"), (8, "\r"))],
        F.struct(F.lit(9).alias("variant"), F.concat(F.lit("/\t//"), host).alias("return_to")),
    )
    rows = p.select("page_id", F.explode(variants).alias("v")).select("page_id", "v.*")
    return A.safe_return_target(rows).select("page_id", "variant", "target", "was_rejected", "has_backslash")


@query("access_decision")
def access_decision_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route (O27) + session (O29) + readiness (O15, dep = customer of the same id)."""
    acc = A.classify_routes(X.event_access(spark, sf_dir))
    val = A.session_validity(acc, X.event_logins(spark, sf_dir), X.event_boots(spark, sf_dir), lifetime_s=2 * 86400)
    rdy = S.readiness(
        X.customer_deployments(spark, sf_dir), X.customer_settings(spark, sf_dir), X.customer_refresh_tokens(spark, sf_dir)
    ).select("deployment_id", "ready")
    j = val.join(rdy, on="deployment_id", how="left")
    out = A.access_decision(j)
    return out.select("deployment_id", "seq", "handler", "decision", F.col("status").cast("string").alias("status"), "location")


@query("upstream_errors")
def upstream_errors_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as upstream replies (status by language, failures by source)."""
    d = table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "text"])
    resp = d.select(
        F.col("doc_id").alias("deployment_id"),
        F.when(F.col("lang") == "de", 404).when(F.col("lang") == "fr", 500).when(F.col("lang") == "es", 399).otherwise(200).alias("status"),
        F.when(F.col("source") == "src3", "connect").when(F.col("source") == "src7", "other").alias("failure"),
        F.col("text").alias("body"),
    )
    out = A.upstream_errors(resp)
    return out.select("deployment_id", F.col("status").cast("bigint").alias("status"), "outcome", "snippet")


# ---------------------------------------------------------------------------
# Logs (O3, O6)
# ---------------------------------------------------------------------------


@query("clean_log_lines")
def clean_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: every event rendered as a raw output line, then cleaned."""
    return clean_log_lines(X.event_log_raw(spark, sf_dir)).select("deployment_id", "seq", "line")


@query("extract_lifecycle_events")
def extract_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed events from the cleaned lines."""
    out = extract_lifecycle_events(clean_log_lines(X.event_log_raw(spark, sf_dir)))
    return out.select(
        "deployment_id", "seq", "event",
        F.col("exit_code").cast("string").alias("exit_code"),
        F.col("delay_s").cast("string").alias("delay_s"),
        F.col("attempt").cast("string").alias("attempt"),
        "method", "path",
        F.col("status").cast("string").alias("status"),
    )
