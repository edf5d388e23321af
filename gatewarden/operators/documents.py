"""Document jobs: config overlay, credential documents, HTML rewrite.

Config documents are handled as leaf rows ``(deployment_id, path, value,
value_type)`` with dotted paths (``model.default``); credential documents as
JSON text parsed into ``VARIANT`` / ``MAP<STRING, VARIANT>``.  No YAML or
JSON codec of our own: Spark's ``parse_json`` / ``from_json`` / ``to_json``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C

# ---------------------------------------------------------------------------
# O10 overlay_config
# ---------------------------------------------------------------------------


def overlay_policy_from_settings(settings: DataFrame, home: str, key: str = "deployment_id", deployments: DataFrame | None = None) -> DataFrame:
    """The boot-time overlay policy per deployment, from its settings; with
    ``deployments`` also for those without any setting.

    model.default forced to the model setting (also when empty); model.provider
    forced to ``auto`` only if some provider key is set; terminal leaves
    forced; agent.max_iterations defaulted; data_dir forced to ``home``;
    custom_providers forced when a custom base URL is set, else removed.
    """
    from ..functions.text import truthy
    from .settings import custom_endpoint_aggs, custom_endpoint_fields, provider_keys

    # One aggregation per deployment over all its settings; a deployment without
    # any joins it as one row without a key.
    if deployments is not None:
        bare = deployments.select(key, F.lit("").alias("key"), F.lit("").alias("value"))
        settings = settings.select(key, "key", "value").unionByName(bare)
    per_dep = settings.groupBy(key).agg(
        F.max(F.when(F.col("key") == C.MODEL_KEY, F.col("value"))).alias("__model"),
        F.bool_or(F.col("key").isin(*provider_keys()) & truthy("value")).alias("__any_provider"),
        *custom_endpoint_aggs(),
    )
    present, fields = custom_endpoint_fields()
    d = per_dep.select(
        key, "__model", "__any_provider", F.when(present, F.to_json(F.array(F.struct(*fields)))).alias("__custom")
    )

    def row(path: str, value: Column, policy: Column | str, vtype: str) -> Column:
        pol = F.lit(policy) if isinstance(policy, str) else policy
        return F.struct(F.lit(path).alias("path"), value.cast("string").alias("value"), pol.alias("policy"), F.lit(vtype).alias("value_type"))

    rows = F.array(
        row("model.default", F.coalesce("__model", F.lit("")), "force", "str"),
        row("model.provider", F.lit("auto"), F.when(F.coalesce("__any_provider", F.lit(False)), "force"), "str"),
        *[row(p, F.lit(v), "force", "int" if v.isdigit() else "str") for p, v in C.TERMINAL_DEFAULTS],
        row("agent.max_iterations", F.lit(str(C.DEFAULT_MAX_ITERATIONS)), "default", "int"),
        row("data_dir", F.lit(home), "force", "str"),
        row("custom_providers", F.col("__custom"), F.when(F.col("__custom").isNotNull(), "force").otherwise("remove"), "list"),
    )
    return d.select(key, F.explode(rows).alias("r")).select(key, "r.*").filter(F.col("policy").isNotNull())


def overlay_policy_from_sign_ins(sign_ins: DataFrame, provider: str, home: str, key: str = "deployment_id") -> DataFrame:
    """The overlay policy of a device-flow sign-in, sign_ins(key, model): the provider
    is forced, the model only where it is given, terminal leaves and the iteration
    limit are defaulted, data_dir is forced to ``home``."""

    def row(path: str, value: Column, policy: Column, vtype: str) -> Column:
        return F.struct(F.lit(path).alias("path"), value.cast("string").alias("value"), policy.alias("policy"), F.lit(vtype).alias("value_type"))

    force, default = F.lit("force"), F.lit("default")
    rows = F.array(
        row("model.default", F.col("model"), F.when(F.length("model") > 0, force), "str"),
        row("model.provider", F.lit(provider), force, "str"),
        *[row(p, F.lit(v), default, "int" if v.isdigit() else "str") for p, v in C.TERMINAL_DEFAULTS],
        row("agent.max_iterations", F.lit(str(C.DEFAULT_MAX_ITERATIONS)), default, "int"),
        row("data_dir", F.lit(home), force, "str"),
    )
    return sign_ins.select(key, F.explode(rows).alias("r")).select(key, "r.*").filter(F.col("policy").isNotNull())


def sign_in_settings(sign_ins: DataFrame, provider: str, key: str = "deployment_id") -> DataFrame:
    """Settings that a sign-in with a model writes back: the model setting and the one
    that remembers the provider's model."""
    names = F.array(F.lit(C.MODEL_KEY), F.lit(f"_MODEL_{provider.upper().replace('-', '_')}"))
    return sign_ins.filter(F.length("model") > 0).select(key, F.explode(names).alias("key"), F.col("model").alias("value"))


def overlay_config(existing: DataFrame, policy: DataFrame, key: str = "deployment_id") -> DataFrame:
    """Apply an overlay policy to config leaves.

    * ``force``: the policy value always wins;
    * ``default``: the policy value only where nothing is there: a leaf with a
      null value counts, and so do leaves below the path;
    * ``remove``: the leaf and everything under it is dropped;
    * a forced scalar replaces any subtree under its path;
    * a managed section (parent of a forced/defaulted leaf) that exists as a
      scalar is replaced by a mapping (the scalar leaf is dropped);
    * every other leaf (unknown sections) is kept.

    A deployment's policy is a handful of rows, folded into one map; the leaves
    join it once, and paths are compared inside the row.
    """
    entry = F.struct("path", F.struct("value", "policy", "value_type").alias("v"))
    rules = policy.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("__rules"))
    leaves = existing.select(key, "path", "value", "value_type")
    j = rules.join(leaves, key, "full_outer")
    path, keys = F.col("path"), F.map_keys("__rules")
    of = lambda k: F.element_at(F.col("__rules"), k)["policy"]
    hit = F.exists(keys, lambda k: (k == path) & of(k).isin("force", "remove"))
    under = F.exists(keys, lambda k: path.startswith(F.concat(k, F.lit("."))) & of(k).isin("force", "remove"))
    section = F.exists(keys, lambda k: k.startswith(F.concat(path, F.lit("."))) & of(k).isin("force", "default"))
    kept = j.filter(path.isNotNull() & ~F.coalesce(hit | under | section, F.lit(False))).select(key, "path", "value", "value_type")
    # Default paths that some leaf takes, per deployment (at most its policy's rows).
    taken = F.filter(keys, lambda k: (of(k) == "default") & ((path == k) | path.startswith(F.concat(k, F.lit(".")))))
    per = j.filter(F.col("__rules").isNotNull()).groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set(taken))).alias("__taken"))
    rows = policy.filter(F.col("policy").isin("force", "default")).join(per, key, "left")
    free = (F.col("policy") == "force") | ~F.coalesce(F.array_contains("__taken", F.col("path")), F.lit(False))
    return kept.unionByName(rows.filter(free).select(key, "path", "value", "value_type"))


# ---------------------------------------------------------------------------
# O31 credential_presence, O32 remove_provider, O33 upsert_provider
# ---------------------------------------------------------------------------


def _truthy_variant(v: Column) -> Column:
    """Python truthiness of a JSON value held in a VARIANT (null-safe)."""
    t = F.schema_of_variant(v)
    s = F.try_variant_get(v, "$", "string")
    return F.coalesce(
        F.when(v.isNull(), F.lit(False))
        .when(t == "STRING", F.length(s) > 0)
        .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(t.startswith("OBJECT") | t.startswith("ARRAY"), ~s.isin("{}", "[]"))
        .when(t == "VOID", F.lit(False))
        .otherwise(F.try_variant_get(v, "$", "double") != 0),
        F.lit(False),
    )


def has_refresh_token(doc: Column, provider: str = "xai-oauth") -> Column:
    """The provider's tokens are an object with a truthy ``refresh_token``;
    anything unreadable or of the wrong type is false."""
    v = F.try_parse_json(doc)
    tokens = F.try_variant_get(v, f'$.providers["{provider}"].tokens', "variant")
    is_obj = F.coalesce(F.schema_of_variant(tokens).startswith("OBJECT"), F.lit(False))
    rt = F.try_variant_get(tokens, "$.refresh_token", "variant")
    return is_obj & _truthy_variant(rt)


def credential_presence(docs: DataFrame, provider: str = "xai-oauth", doc: str = "doc", key: str = "deployment_id") -> DataFrame:
    """O31 per document: ``(key, has_refresh_token)``."""
    return docs.select(key, has_refresh_token(F.col(doc), provider).alias("has_refresh_token"))


DOC_MAP = "map<string, variant>"


def parse_doc(doc: Column) -> Column:
    """Top level of a JSON object document as MAP<STRING, VARIANT> (null if not an object)."""
    return F.from_json(doc, DOC_MAP)


def _deepest(docs: DataFrame, doc: str) -> int:
    """The most objects open at once in any JSON document."""
    bare = F.regexp_replace(F.col(doc), r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    braces = F.split(F.regexp_replace(bare, r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["top"], now).alias("top"))

    return docs.filter(F.try_parse_json(doc).isNotNull()).agg(F.max(F.aggregate(braces, start, step)["top"])).first()[0] or 0


def document_leaves(docs: DataFrame, doc: str = "doc", key: str = "deployment_id") -> DataFrame:
    """``(key, path, value)``: every scalar and every empty object or array of JSON
    documents, of any depth; a text that is no JSON object is one row with path ``$``.

    One pass opens a level after the other, as many as the deepest document has
    (counted first); rows that are leaves already pass through.
    """
    v = F.try_parse_json(doc)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    at = lambda path, value: F.struct(path.alias("path"), value.alias("v"))
    rows = docs.select(key, F.when(~is_object, F.col(doc)).alias("plain"), at(F.lit("$"), F.when(is_object, v)).alias("at"))
    path, value = F.col("at.path"), F.col("at.v")
    kind = F.coalesce(F.schema_of_variant(value), F.lit(""))
    for _ in range(_deepest(docs, doc)):
        entries = F.map_entries(F.from_json(F.to_json(value), DOC_MAP))
        inner = F.transform(entries, lambda e: at(F.concat(path, F.lit("."), e["key"]), e["value"]))
        nested = kind.startswith("OBJECT") & (F.to_json(value) != "{}")
        rows = rows.select(key, "plain", F.explode(F.when(nested, inner).otherwise(F.array(F.col("at")))).alias("at"))
    leaf = F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))
    return rows.select(key, path.alias("path"), F.coalesce("plain", leaf).alias("value"))


def remove_provider(docs: DataFrame, name: str, doc: str = "doc") -> DataFrame:
    """Delete ``providers[name]``; clear ``active_provider`` only if it was ``name``.
    A document that is unreadable, or whose ``providers`` is there but no object,
    is left unchanged.  Output column ``doc`` (JSON)."""
    m = parse_doc(F.col(doc))
    providers = F.try_element_at(m, F.lit("providers"))
    prov_map = F.from_json(F.to_json(providers), DOC_MAP)
    new_prov = F.map_filter(prov_map, lambda k, v: k != F.lit(name))
    active = F.try_variant_get(F.try_element_at(m, F.lit("active_provider")), "$", "string")
    m2 = F.map_filter(m, lambda k, v: ~((k == F.lit("active_provider")) & F.coalesce(active == F.lit(name), F.lit(False))))
    m3 = F.when(
        prov_map.isNotNull(),
        F.map_concat(
            F.map_filter(m2, lambda k, v: k != F.lit("providers")),
            F.create_map(F.lit("providers"), F.parse_json(F.to_json(new_prov))),
        ),
    ).otherwise(m2)
    usable = m.isNotNull() & (prov_map.isNotNull() | ~F.map_contains_key(m, "providers"))
    return docs.withColumn(doc, F.when(usable, F.to_json(m3)).otherwise(F.col(doc)))


def drop_provider_model(settings: DataFrame, name: str) -> DataFrame:
    """O32, settings side: the model remembered for the removed provider goes too."""
    return settings.filter(F.col("key") != F.lit(f"_MODEL_{name.upper().replace('-', '_')}"))


def upsert_provider(
    docs: DataFrame,
    name: str,
    tokens: Column,
    as_of: Column,
    auth_mode: str = "oauth_device",
    extra: dict[str, object] | None = None,
    doc: str = "doc",
) -> DataFrame:
    """Set ``providers[name]`` = {tokens, auth_mode, last_refresh, redirect_uri,
    **extra}, make it active (``extra``: any JSON values, nested blocks too), stamp version 2 and ``updated_at``.  A document
    that is not a JSON object is replaced by a fresh one."""
    stamp = F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.struct(
        F.parse_json(F.to_json(tokens) if not isinstance(tokens, str) else F.lit(tokens)).alias("tokens"),
        F.lit(auth_mode).alias("auth_mode"),
        stamp.alias("last_refresh"),
        *[F.parse_json(F.lit(json.dumps(v))).alias(k) for k, v in (extra or {}).items()],
        F.lit("").alias("redirect_uri"),
    )
    m = F.coalesce(parse_doc(F.col(doc)), F.create_map().cast(DOC_MAP))
    prov_map = F.coalesce(
        F.from_json(F.to_json(F.try_element_at(m, F.lit("providers"))), DOC_MAP), F.create_map().cast(DOC_MAP)
    )
    new_prov = F.map_concat(
        F.map_filter(prov_map, lambda k, v: k != F.lit(name)),
        F.create_map(F.lit(name), F.parse_json(F.to_json(block))),
    )
    keep = F.map_filter(m, lambda k, v: ~k.isin("providers", "active_provider", "version", "updated_at"))
    out = F.map_concat(
        keep,
        F.create_map(
            F.lit("providers"), F.parse_json(F.to_json(new_prov)),
            F.lit("active_provider"), F.parse_json(F.lit(json.dumps(name))),
            F.lit("version"), F.parse_json(F.lit("2")),
            F.lit("updated_at"), F.parse_json(F.concat(F.lit('"'), stamp, F.lit('"'))),
        ),
    )
    return docs.withColumn(doc, F.to_json(out))


# ---------------------------------------------------------------------------
# O34 inject_html
# ---------------------------------------------------------------------------


def inject_html(pages: DataFrame, snippet: str, html: str = "html", content_type: str | Column | None = None) -> DataFrame:
    """Insert ``snippet`` before the *first* ``</body>`` of HTML responses.

    Applies when the lower-cased content type contains ``text/html`` (or no
    content type column is given) and the body contains the case-sensitive
    tag; otherwise the page is unchanged.  Adds ``injected``.
    """
    tag = "</body>"
    h = F.col(html)
    is_html = F.lit(True) if content_type is None else F.coalesce(
        F.lower(F.col(content_type) if isinstance(content_type, str) else content_type).contains("text/html"), F.lit(False)
    )
    hit = is_html & F.coalesce(h.contains(tag), F.lit(False))
    before = F.substring_index(h, tag, 1)
    rest = h.substr(F.length(before) + 1, F.lit(2**31 - 1))
    return pages.withColumn("injected", hit).withColumn(
        html, F.when(hit, F.concat(before, F.lit(snippet), rest)).otherwise(h)
    )
