"""Settings jobs over a fleet's ``.env`` snapshots.

``settings`` is a long table ``(deployment_id, key, value)`` (plus optional
``path``, ``line_no``, ``snapshot_ts``).  The registry is a small fixed list
(58 entries, :data:`gatewarden.functions.constants.REGISTRY`); lookups into
it are compiled into literal maps, so they run inside the projection's
generated code with no join and no broadcast exchange.  A caller may pass its
own registry list of the same shape.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import bool_like, provider_label, py_strip, slug, truthy

Registry = Sequence[tuple[str, str, str, bool]]


def _lit_map(pairs: Sequence[tuple[object, object]]) -> Column:
    flat = []
    for k, v in pairs:
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def _lookup(pairs: Sequence[tuple[object, object]], key: Column) -> Column:
    return F.try_element_at(_lit_map(pairs), key)


def category_of(key: str | Column, registry: Registry = C.REGISTRY) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.coalesce(_lookup([(e[0], e[2]) for e in registry], k), F.lit(C.OTHER_CATEGORY[0]))


def is_secret(key: str | Column, registry: Registry = C.REGISTRY) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.coalesce(_lookup([(e[0], e[3]) for e in registry], k), F.lit(False))


def registry_ord(key: str | Column, registry: Registry = C.REGISTRY) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return _lookup([(e[0], i) for i, e in enumerate(registry)], k)


def provider_keys(registry: Registry = C.REGISTRY) -> list[str]:
    return [e[0] for e in registry if e[2] == "provider"]


# ---------------------------------------------------------------------------
# O14 effective_settings
# ---------------------------------------------------------------------------


def effective_settings(parsed: DataFrame, keys: Sequence[str] = ("deployment_id", "path")) -> DataFrame:
    """Duplicate key in one file: the last line wins (``max_by(value, line_no)``,
    partially aggregated map-side)."""
    keys = list(keys)
    return parsed.groupBy(*keys, "key").agg(F.max_by("value", "line_no").alias("value"))


# ---------------------------------------------------------------------------
# O11 categorise_settings, O7 mask_settings
# ---------------------------------------------------------------------------


def categorise_settings(settings: DataFrame, registry: Registry = C.REGISTRY) -> DataFrame:
    """Add ``category`` (unknown key -> ``other``), ``is_secret`` and registry ``ord``."""
    return settings.withColumns(
        {
            "category": category_of("key", registry),
            "is_secret": is_secret("key", registry),
            "ord": registry_ord("key", registry),
        }
    )


def mask_value(key: Column, value: Column, registry: Registry = C.REGISTRY) -> Column:
    n = C.MASK_PREFIX_CHARS
    masked = F.when(F.length(value) > n, F.concat(F.substring(value, 1, n), F.lit(C.MASK_SUFFIX))).otherwise(
        F.lit(C.MASK_SUFFIX)
    )
    return F.when(is_secret(key, registry) & (F.length(value) > 0), masked).otherwise(value)


def mask_settings(settings: DataFrame, registry: Registry = C.REGISTRY) -> DataFrame:
    """Secret and non-empty: first 8 chars + ``***`` if longer than 8, else ``***``.
    Keys outside the registry are never masked."""
    return settings.withColumn("value", mask_value(F.col("key"), F.col("value"), registry))


# ---------------------------------------------------------------------------
# O12 apply_masked_update
# ---------------------------------------------------------------------------


def apply_masked_update(
    new: DataFrame,
    existing: DataFrame,
    registry: Registry = C.REGISTRY,
    key: str = "deployment_id",
) -> DataFrame:
    """Merge an update into stored settings, as a full outer join on (dep, key).

    * an updated secret whose value ends with ``***`` keeps the stored value
      (empty if none is stored);
    * keys absent from the update are carried over;
    * empty values vanish (they are not written).
    """
    n = new.select(key, "key", F.col("value").alias("__new"))
    e = existing.select(key, "key", F.col("value").alias("__old"))
    j = n.join(e, on=[key, "key"], how="full_outer")
    unmasked = F.when(
        is_secret("key", registry) & F.col("__new").endswith(C.MASK_SUFFIX), F.coalesce(F.col("__old"), F.lit(""))
    ).otherwise(F.col("__new"))
    merged = F.when(F.col("__new").isNotNull(), unmasked).otherwise(F.col("__old"))
    return j.select(key, "key", merged.alias("value")).filter(F.length("value") > 0)


# ---------------------------------------------------------------------------
# O13 layer_settings
# ---------------------------------------------------------------------------


def layer_settings(layers: DataFrame, key: str = "deployment_id") -> DataFrame:
    """Layered settings (process env, home value, file): highest ``priority`` wins."""
    return layers.groupBy(key, "key").agg(F.max_by("value", "priority").alias("value"))


# ---------------------------------------------------------------------------
# O4 render_dotenv
# ---------------------------------------------------------------------------


def render_dotenv(settings: DataFrame, registry: Registry = C.REGISTRY, key: str = "deployment_id") -> DataFrame:
    """Render ``.env`` text per deployment.

    Non-empty values only; entries ``key=value`` grouped by category in the
    fixed category order ("other" last), sorted by the rendered text within a
    group, a ``# Title`` header per group and a blank line after it.  Every
    deployment of the input comes out, with empty text if no value is left.

    Two aggregation steps: per (dep, category) the entries are collected and
    sorted (bounded by one file's keys), then the blocks are ordered per dep.
    """
    cats = list(C.CATEGORIES) + [C.OTHER_CATEGORY]
    cat_ord = _lit_map([(c, i) for i, (c, _) in enumerate(cats)])
    cat_title = _lit_map([(c, t) for c, t in cats])
    entry = F.when(F.length("value") > 0, F.concat("key", F.lit("="), "value"))
    s = settings.select(key, category_of("key", registry).alias("category"), entry.alias("entry"))
    groups = s.groupBy(key, "category").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    block = F.concat(
        F.lit("# "),
        F.coalesce(F.try_element_at(cat_title, F.col("category")), F.col("category")),
        F.lit("\n"),
        F.array_join("entries", "\n"),
        F.lit("\n"),
    )
    ordered = F.struct(F.try_element_at(cat_ord, F.col("category")).alias("o"), block.alias("b"))
    groups = groups.select(key, F.when(F.size("entries") > 0, ordered).alias("blk"))
    out = groups.groupBy(key).agg(F.array_sort(F.collect_list("blk")).alias("blks"))
    return out.select(key, F.array_join(F.transform("blks", lambda b: b["b"]), "\n").alias("text"))


def render_dotenv_lines(settings: DataFrame, registry: Registry = C.REGISTRY, key: str = "deployment_id") -> DataFrame:
    """O4 as ordered lines, nothing collected: ``(key, cat_ord, part, line)``.

    ``part`` is 0 for the ``# Title`` header, 1 for ``key=value`` entries and
    2 for the blank line after a group (none after the last group).  Ordered
    by (cat_ord, part, line) within a deployment and each ended by a newline,
    the lines give exactly :func:`render_dotenv`'s text.  This is the form
    for writing files: a deployment with a huge number of keys is sorted
    (with spill), never held in one array.  A deployment without any value
    left gives one blank line (0, 2, ""), so that its file is replaced.
    """
    cats = list(C.CATEGORIES) + [C.OTHER_CATEGORY]
    cat_ord = _lit_map([(c, i) for i, (c, _) in enumerate(cats)])
    cat_title = _lit_map([(c, t) for c, t in cats])
    s = settings.select(
        key,
        F.try_element_at(cat_ord, category_of("key", registry)).alias("cat_ord"),
        category_of("key", registry).alias("__cat"),
        F.when(F.length("value") > 0, F.concat("key", F.lit("="), "value")).alias("line"),
    )
    # The categories of a deployment: a set of at most len(cats) entries
    # whatever its row count, partially aggregated map-side.  Headers and the
    # blank lines between groups come from it in one pass.
    used = F.when(F.col("line").isNotNull(), F.struct("cat_ord", "__cat"))
    per_dep = s.groupBy(key).agg(F.array_sort(F.collect_set(used)).alias("__cats"))

    def line(c: Column, part: int, text: Column) -> Column:
        return F.struct(c["cat_ord"].alias("cat_ord"), F.lit(part).alias("part"), text.alias("line"))

    def lines_of(c: Column, i: Column) -> Column:
        header = line(c, 0, F.concat(F.lit("# "), F.try_element_at(cat_title, c["__cat"])))
        return F.when(i < F.size("__cats") - 1, F.array(header, line(c, 2, F.lit("")))).otherwise(F.array(header))

    blank = F.array(F.struct(F.lit(0).alias("cat_ord"), F.lit(2).alias("part"), F.lit("").alias("line")))
    headers = F.flatten(F.transform("__cats", lines_of))
    frame = per_dep.select(key, F.inline(F.when(F.size("__cats") > 0, headers).otherwise(blank)))
    entries = s.filter(F.col("line").isNotNull()).select(key, "cat_ord", F.lit(1).alias("part"), "line")
    return frame.unionByName(entries)


# ---------------------------------------------------------------------------
# O15 readiness, O18 first_configured
# ---------------------------------------------------------------------------


def readiness(
    deployments: DataFrame,
    settings: DataFrame,
    refresh_tokens: DataFrame | None = None,
    registry: Registry = C.REGISTRY,
    key: str = "deployment_id",
) -> DataFrame:
    """Ready = model set AND (any provider key set OR a refresh token exists).

    Every deployment in ``deployments`` comes out, also one without settings.
    ``refresh_tokens`` is ``(dep, has_refresh_token)`` from
    :func:`gatewarden.operators.documents.credential_presence`.
    """
    provs = provider_keys(registry)
    per_dep = settings.groupBy(key).agg(
        F.bool_or((F.col("key") == C.MODEL_KEY) & truthy("value")).alias("has_model"),
        F.bool_or(F.col("key").isin(*provs) & truthy("value")).alias("has_provider"),
    )
    out = deployments.select(key).distinct().join(per_dep, on=key, how="left")
    if refresh_tokens is not None:
        rt = refresh_tokens.groupBy(key).agg(F.bool_or("has_refresh_token").alias("has_refresh_token"))
        out = out.join(rt, on=key, how="left")
    else:
        out = out.withColumn("has_refresh_token", F.lit(False))
    hm = F.coalesce("has_model", F.lit(False))
    hp = F.coalesce("has_provider", F.lit(False))
    hr = F.coalesce("has_refresh_token", F.lit(False))
    return out.select(
        key,
        hm.alias("has_model"),
        (hp | hr).alias("has_provider"),
        (hm & (hp | hr)).alias("ready"),
    )


def first_configured(settings: DataFrame, registry: Registry = C.REGISTRY, key: str = "deployment_id") -> DataFrame:
    """First non-empty provider key in registry order: ``min_by(struct(key, value), ord)``."""
    provs = provider_keys(registry)
    s = settings.filter(F.col("key").isin(*provs) & truthy("value")).withColumn("__ord", registry_ord("key", registry))
    return s.groupBy(key).agg(F.min_by(F.struct("key", "value"), "__ord").alias("__f")).select(
        key, F.col("__f.key").alias("key"), F.col("__f.value").alias("value")
    )


# ---------------------------------------------------------------------------
# O25 integration_status
# ---------------------------------------------------------------------------


def integration_catalogue(registry: Registry = C.REGISTRY) -> list[tuple[str, str, str, int]]:
    """(kind, name, settings key, ord) for every provider and channel."""
    items = [("provider", provider_label(k), k, i) for i, k in enumerate(provider_keys(registry))]
    items += [("channel", name, k, i) for i, (name, k) in enumerate(C.CHANNELS)]
    return items


def _integration_values(
    deployments: DataFrame, settings: DataFrame, registry: Registry = C.REGISTRY, key: str = "deployment_id"
) -> DataFrame:
    """One row per deployment with one column per catalogue key (its value).

    A ``pivot`` with explicit values over the wanted keys only: one
    aggregation (partial map-side), no value-discovery pass, and a join of two
    one-row-per-deployment tables to keep deployments without settings.
    """
    wanted = list(dict.fromkeys(s for _, _, s, _ in integration_catalogue(registry)))
    pv = settings.filter(F.col("key").isin(*wanted)).groupBy(key).pivot("key", wanted).agg(F.max("value"))
    return deployments.select(key).distinct().join(pv, on=key, how="left")


def _configured(kind: str, value: Column) -> Column:
    return bool_like(value) if kind == "channel" else truthy(value)


def integration_status(
    deployments: DataFrame, settings: DataFrame, registry: Registry = C.REGISTRY, key: str = "deployment_id"
) -> DataFrame:
    """Every provider and channel per deployment, set or not.

    Providers use plain truthiness, channels the bool-like rule.  The values
    come from :func:`_integration_values` (one pivot), and the fixed catalogue
    is unrolled per deployment with ``explode`` of a literal array: no cross
    join, no row-level join with the settings.
    """
    cat = integration_catalogue(registry)
    vals = _integration_values(deployments, settings, registry, key)
    arr = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), _configured(k, F.col(f"`{s}`")).alias("configured"))
            for k, n, s, _ in cat
        ]
    )
    return vals.select(key, F.explode(arr).alias("i")).select(key, "i.*")


def integration_column(kind: str, settings_key: str) -> str:
    return f"{kind}_{settings_key.lower()}"


def integration_matrix(
    deployments: DataFrame, settings: DataFrame, registry: Registry = C.REGISTRY, key: str = "deployment_id"
) -> DataFrame:
    """O25 pivoted: one row per deployment, one boolean column per provider
    and channel (``provider_<key>`` / ``channel_<key>``), straight from the
    pivoted values."""
    cat = integration_catalogue(registry)
    vals = _integration_values(deployments, settings, registry, key)
    return vals.select(key, *[_configured(k, F.col(f"`{s}`")).alias(integration_column(k, s)) for k, _, s, _ in cat])


# ---------------------------------------------------------------------------
# O28 custom_endpoints
# ---------------------------------------------------------------------------


CUSTOM_KEYS = ("CUSTOM_PROVIDER_BASE_URL", "CUSTOM_PROVIDER_NAME")


def custom_endpoint_aggs() -> list[Column]:
    """Aggregates (per deployment) that :func:`custom_endpoint_fields` reads."""
    return [
        F.max(F.when(F.col("key") == "CUSTOM_PROVIDER_BASE_URL", F.col("value"))).alias("__url"),
        F.max(F.when(F.col("key") == "CUSTOM_PROVIDER_NAME", F.col("value"))).alias("__name"),
    ]


def custom_endpoint_fields() -> tuple[Column, list[Column]]:
    """``(present, [name, base_url, key_env])`` over :func:`custom_endpoint_aggs`."""
    url = py_strip(F.coalesce("__url", F.lit("")))
    raw_name = F.coalesce(F.nullif(py_strip(F.coalesce("__name", F.lit(""))), F.lit("")), url)
    return F.length(url) > 0, [slug(raw_name).alias("name"), url.alias("base_url"), F.lit(C.CUSTOM_KEY_ENV).alias("key_env")]


def custom_endpoints(settings: DataFrame, key: str = "deployment_id") -> DataFrame:
    """A row when the custom base URL is non-blank; name = slug of the given
    name, else of the URL, else ``custom``."""
    p = settings.filter(F.col("key").isin(*CUSTOM_KEYS)).groupBy(key).agg(*custom_endpoint_aggs())
    present, fields = custom_endpoint_fields()
    return p.filter(present).select(key, *fields)
