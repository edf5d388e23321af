"""Access-log jobs: header scrubbing, route classification, session validity,
access decisions, safe return targets, upstream error lines.

``access(deployment_id, session_id, ts, seq, method, path, query, accept,
headers MAP<STRING,STRING>, kind)`` — ``kind`` is ``http`` (default) or ``ws``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import quote_path
from .scans import DEFAULT_BUCKET_S, ScanSpec, micros, ordered_scan

# ---------------------------------------------------------------------------
# O9 scrub_headers
# ---------------------------------------------------------------------------


def scrub_headers(access: DataFrame, names: Sequence[str] = C.HOP_BY_HOP, headers: str = "headers") -> DataFrame:
    """Drop the named headers (compared in lower case) with ``map_filter``."""
    drop = [n.lower() for n in names]
    return access.withColumn(headers, F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*drop)))


def scrub_response_headers(responses: DataFrame, headers: str = "headers") -> DataFrame:
    """Response side: hop-by-hop plus the length/encoding headers."""
    return scrub_headers(responses, tuple(C.HOP_BY_HOP) + tuple(C.RESPONSE_EXTRA_DROP), headers)


# ---------------------------------------------------------------------------
# O27 classify_routes
# ---------------------------------------------------------------------------


def _path_match(pattern: str, path: Column) -> Column:
    if pattern.endswith("{path:path}"):
        return path.startswith(pattern[: -len("{path:path}")])
    return path == F.lit(pattern)


def _method_ok(methods: tuple[str, ...] | None, method: Column) -> Column:
    allowed = set(methods or ("GET",))
    if "GET" in allowed:
        allowed.add("HEAD")
    return method.isin(*sorted(allowed))


def classify_routes(
    access: DataFrame,
    routes: Sequence[tuple[str, str, tuple[str, ...] | None, str]] = C.ROUTES,
    path: str = "path",
    method: str = "method",
    kind: str | None = "kind",
) -> DataFrame:
    """First route, in list order, whose path pattern and method match.

    If a route matches the path but not the method and no later route fully
    matches, the request ends as ``method_not_allowed`` (405); no path match
    at all is ``not_found``.  HTTP and WebSocket routes are separate name
    spaces.  The route list is small and fixed, so it is compiled into one
    ``CASE WHEN`` chain evaluated in the scan's generated code: no join.
    Adds ``handler``, ``route_index`` and ``is_public``.
    """
    p, m = F.col(path), F.upper(F.col(method))
    k = F.col(kind) if kind and kind in access.columns else F.lit("http")
    full = None
    partial = None
    for i, (rkind, pattern, methods, handler) in enumerate(routes):
        pm = (k == F.lit(rkind)) & _path_match(pattern, p)
        hit = pm if rkind == "ws" else pm & _method_ok(methods, m)
        val = F.struct(F.lit(handler).alias("h"), F.lit(i).alias("i"))
        full = F.when(hit, val) if full is None else full.when(hit, val)
        if rkind == "http":
            pv = F.struct(F.lit("method_not_allowed").alias("h"), F.lit(i).alias("i"))
            partial = F.when(pm, pv) if partial is None else partial.when(pm, pv)
    none = F.struct(F.lit("not_found").alias("h"), F.lit(None).cast("int").alias("i"))
    r = F.coalesce(full, partial, none)
    out = access.withColumn("__r", r)
    return out.withColumns(
        {
            "handler": F.col("__r.h"),
            "route_index": F.col("__r.i"),
            "is_public": F.col("__r.h").isin(*C.PUBLIC_HANDLERS),
        }
    ).drop("__r")


# Rules of a table that are broadcast to the requests' paths; more are joined by key.
MAX_BROADCAST_RULES = 100_000
# Copies of a larger table's rules, so that a hot node's paths spread over as many tasks.
RULE_COPIES = 8
_REST = "{path:path}"


def routes_table(spark: SparkSession, routes: Sequence[tuple[str, str, tuple[str, ...] | None, str]] = C.ROUTES) -> DataFrame:
    """A route list in the form of :func:`classify_routes_by_table` (without deployments)."""
    rows = [(i, kind, pattern, list(methods) if methods else None, handler) for i, (kind, pattern, methods, handler) in enumerate(routes)]
    return spark.createDataFrame(rows, "priority int, kind string, pattern string, methods array<string>, handler string")


def _rule_nodes(rules: DataFrame) -> DataFrame:
    """(rn_kind, rn_node, rn_rest, ...): a rule hangs at its exact path, or at the whole
    segments of its prefix with the rest of the prefix kept beside."""
    pattern = F.col("pattern")
    open_ = pattern.endswith(_REST)
    prefix = F.substring(pattern, F.lit(1), F.char_length(pattern) - len(_REST))
    whole = F.regexp_extract(prefix, r"(?s)^(.*/)?", 0)
    allowed = F.coalesce(F.transform("methods", lambda m: F.upper(m)), F.array(F.lit("GET")))
    allowed = F.when(F.size(allowed) == 0, F.array(F.lit("GET"))).otherwise(allowed)
    allowed = F.when(F.array_contains(allowed, "GET"), F.array_append(allowed, F.lit("HEAD"))).otherwise(allowed)
    return rules.select(
        *([F.col("deployment_id").alias("rn_dep")] if "deployment_id" in rules.columns else []),
        F.col("kind").alias("rn_kind"),
        F.when(open_, F.concat(F.lit("*"), whole)).otherwise(F.concat(F.lit("="), pattern)).alias("rn_node"),
        F.when(open_, F.substring(prefix, F.char_length(whole) + 1, F.char_length(prefix))).otherwise(F.lit("")).alias("rn_rest"),
        allowed.alias("rn_methods"),
        F.col("priority").cast("int").alias("rn_priority"),
        F.col("handler").alias("rn_handler"),
    )


def classify_routes_by_table(
    access: DataFrame,
    rules: DataFrame,
    path: str = "path",
    method: str = "method",
    kind: str | None = "kind",
    max_broadcast_rules: int = MAX_BROADCAST_RULES,
) -> DataFrame:
    """:func:`classify_routes` with the rules of a table, of any number:
    rules([deployment_id,] priority, kind, pattern, methods, handler), the lowest
    priority first; with a ``deployment_id`` each deployment has its own.

    The outcome depends on (deployment, kind, path, method) only, so requests are
    reduced to those (partially aggregated map-side).  Each path emits its nodes -
    itself, and its prefixes that end in a slash, as many as it has segments - and
    meets the rules that hang there by an equi-join; a rule whose prefix ends inside
    a segment tests the rest.  The lowest priorities of a full and of a path-only
    match per path decide, and are joined back.  Up to ``max_broadcast_rules``
    (counted) the rules are broadcast; beyond that they are copied over
    ``RULE_COPIES`` keys, as one node such as ``/`` may take all paths.

    A null path, method or kind matches nothing (``not_found``; a null method still
    meets a path: 405).  Two rules of one priority: the lesser handler's name wins.
    """
    by_dep = "deployment_id" in rules.columns
    k = F.col(kind) if kind and kind in access.columns else F.lit("http")
    key = {"__k": k, "__p": F.col(path), "__m": F.upper(F.col(method))}
    if by_dep:
        key["__d"] = F.col("deployment_id")
    wanted = access.select(*[c.alias(n) for n, c in key.items()]).distinct()
    nodes = _rule_nodes(rules)
    few = nodes.limit(max_broadcast_rules + 1).count() <= max_broadcast_rules
    if few:
        nodes, salt = F.broadcast(nodes.withColumn("rn_salt", F.lit(0))), F.lit(0)
    else:
        nodes = nodes.withColumn("rn_salt", F.explode(F.sequence(F.lit(0), F.lit(RULE_COPIES - 1))))
        salt = F.pmod(F.xxhash64("__p", "__m"), F.lit(RULE_COPIES)).cast("int")
    # The k-th prefix that ends in a slash, for each slash of the path, and the empty one.
    parts = F.split("__p", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.lit("*"), F.array_join(F.slice(parts, 1, i), "/"), F.when(i > 0, "/").otherwise("")))
    own = F.concat(prefixes, F.array(F.concat(F.lit("="), F.col("__p"))))
    at = wanted.filter(F.col("__p").isNotNull()).select("*", salt.alias("__s"), F.explode(F.array_distinct(own)).alias("__n"))
    on = (F.col("__n") == F.col("rn_node")) & (F.col("__k") == F.col("rn_kind")) & (F.col("__s") == F.col("rn_salt"))
    if by_dep:
        on = on & (F.col("__d") == F.col("rn_dep"))
    rest = F.when(F.col("__n").startswith("*"), F.substring("__p", F.char_length("__n"), F.char_length("__p"))).otherwise(F.lit(""))
    hits = at.join(nodes, on).filter(rest.startswith(F.col("rn_rest")))
    ok = (F.col("__k") == "ws") | F.coalesce(F.array_contains("rn_methods", F.col("__m")), F.lit(False))
    hit = F.struct(F.col("rn_priority").alias("i"), F.col("rn_handler").alias("h"))
    best = hits.groupBy(*key).agg(F.min(F.when(ok, hit)).alias("__full"), F.min(F.when(F.col("__k") == "http", F.col("rn_priority"))).alias("__part"))
    best = best.select(*[F.col(n).alias(f"{n}b") for n in key], "__full", "__part")
    same = None
    for n, c in key.items():
        equal = c.eqNullSafe(F.col(f"{n}b"))
        same = equal if same is None else same & equal
    out = access.join(best, same, "left")
    handler = F.coalesce("__full.h", F.when(F.col("__part").isNotNull(), "method_not_allowed"), F.lit("not_found"))
    out = out.withColumns({"handler": handler, "route_index": F.coalesce("__full.i", "__part")})
    return out.withColumn("is_public", F.col("handler").isin(*C.PUBLIC_HANDLERS)).drop("__full", "__part", *[f"{n}b" for n in key])


# ---------------------------------------------------------------------------
# O29 session_validity
# ---------------------------------------------------------------------------


def session_validity(
    access: DataFrame,
    logins: DataFrame,
    boots: DataFrame | None = None,
    lifetime_s: int = C.SESSION_LIFETIME_S,
    key: str = "deployment_id",
    bucket_s: int = DEFAULT_BUCKET_S,
) -> DataFrame:
    """Is the session cookie of each request valid at the request time?

    The token in use is the one of the latest login of that session at or
    before the request (as-of).  It is valid while ``ts <= expiry second``
    (``int(login time) + lifetime``, compared against the fractional clock)
    and only if no boot of the deployment happened after the login and up to
    the request (the signing secret is per process; a boot at the login's own
    time counts as before it).  Logout does not revoke a token.

    Both lookups are linear as-of scans (union + last non-null) with the
    skew-safe :func:`ordered_scan`, never range joins:

    1. each login gets the first boot of its deployment strictly after it,
       by a reverse scan over logins and boots only (small inputs);
    2. each request gets its session's latest login (with that next boot) by
       one forward scan over requests and annotated logins.  The request rows
       travel through the scan, so the access table is shuffled once and
       never joined back.

    A request then is of the login's process iff the next boot is later than
    the request.  Adds ``login_ts`` and ``valid``.
    """
    lg = logins.select(key, "session_id", micros("ts").alias("__t"))
    if boots is not None:
        # Reverse time (negated microseconds): the "last" boot seen before a
        # login in reverse order is the next boot after it in time.  At equal
        # times the login sorts first, so a boot at the login's time is not
        # "after" it.
        lr = lg.select(
            key, "session_id", (-F.col("__t")).alias("__r"), F.lit(0).alias("__o"), F.col("__t").alias("__login"),
            F.lit(None).cast("bigint").alias("__boot"),
        )
        br = boots.select(
            key, F.lit(None).cast("string").alias("session_id"), (-micros("ts")).alias("__r"), F.lit(1).alias("__o"),
            F.lit(None).cast("bigint").alias("__login"), micros("ts").alias("__boot"),
        )
        nb = ordered_scan(
            lr.unionByName(br), [key], "__r", ["__r", "__o"], [ScanSpec("__next_boot", "last", F.col("__boot"))], bucket_s
        )
        lg = nb.filter(F.col("__o") == 0).select(key, "session_id", F.col("__login").alias("__t"), "__next_boot")
    else:
        lg = lg.withColumn("__next_boot", F.lit(None).cast("bigint"))
    info = "struct<login:bigint,next_boot:bigint>"
    lrows = lg.select(
        key, "session_id", "__t", F.lit(0).alias("__row"),
        F.struct(F.col("__t").alias("login"), F.col("__next_boot").alias("next_boot")).alias("__li"),
    )
    acc = access.withColumns({"__t": micros("ts"), "__row": F.lit(1), "__li": F.lit(None).cast(info)})
    # logins sort before requests of the same time: a login at the request's
    # own time is in effect for it
    scanned = ordered_scan(
        acc.unionByName(lrows, allowMissingColumns=True), [key, "session_id"], "__t", ["__t", "__row"],
        [ScanSpec("__last", "last", F.col("__li"))], bucket_s,
    ).filter(F.col("__row") == 1)
    login = F.col("__last.login")
    next_boot = F.col("__last.next_boot")
    expiry_us = (F.floor(login / F.lit(1_000_000)) + F.lit(int(lifetime_s))) * F.lit(1_000_000)
    same_process = next_boot.isNull() | (next_boot > F.col("__t"))
    valid = login.isNotNull() & same_process & (F.col("__t") <= expiry_us)
    out = scanned.withColumns({"login_ts": F.timestamp_micros(login), "valid": F.coalesce(valid, F.lit(False))})
    return out.select(*access.columns, "login_ts", "valid")


def token_expiry(token: str | Column) -> Column:
    """Expiry second of a ``<expires>.<signature>`` session token: the text
    before the *last* dot as an integer; null if malformed (no dot, not a number)."""
    t = F.col(token) if isinstance(token, str) else token
    sig = F.substring_index(t, ".", -1)
    head = t.substr(F.lit(1), F.length(t) - F.length(sig) - 1)
    return F.when(t.contains("."), F.trim(head).try_cast("bigint"))


def token_unexpired(token: str | Column, ts: str | Column) -> Column:
    """The expiry rule alone (signature checks are not built): valid while the
    request time is not past the whole expiry second."""
    t = F.col(ts) if isinstance(ts, str) else ts
    exp = token_expiry(token)
    return F.coalesce(micros(t) <= exp * F.lit(1_000_000), F.lit(False))


# ---------------------------------------------------------------------------
# O36 safe_return_target
# ---------------------------------------------------------------------------


def safe_return_target(df: DataFrame, value: str = "return_to") -> DataFrame:
    """Only same-origin relative paths survive; anything else becomes ``/``.

    Rejected: empty, not starting with ``/``, starting with ``//``, or carrying
    a host once tab, CR and LF are removed, as URL parsers do (a text that
    starts with ``/`` has no scheme).  The output keeps the text as given.
    ``has_backslash`` flags ``/\\host``-style targets that pass the rule but
    that browsers may read as a host.
    """
    v = F.coalesce(F.col(value), F.lit(""))
    host = F.regexp_extract(F.translate(v, "\t\r\n", ""), r"^//([^/?#]*)", 1)
    bad = ~v.startswith("/") | v.startswith("//") | (host != "")
    return df.withColumns(
        {
            "target": F.when(bad, F.lit("/")).otherwise(v),
            "was_rejected": bad,
            "has_backslash": v.contains("\\"),
        }
    )


# ---------------------------------------------------------------------------
# O35 access_decision
# ---------------------------------------------------------------------------


def query_param_last(query: Column, name: str) -> Column:
    """Last value of ``name`` in a query string (multi-dict ``get`` semantics);
    a bare ``name`` gives ``''``; absent gives null."""
    parts = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: (x == F.lit(name)) | x.startswith(name + "="))
    last = F.try_element_at(parts, F.lit(-1))
    eq = F.instr(last, "=")
    return F.when(eq > 0, last.substr(eq + 1, F.lit(2**31 - 1))).when(last.isNotNull(), F.lit(""))


def access_decision(classified: DataFrame, ready: Column | None = None) -> DataFrame:
    """Decision per request, from the route (O27), the session (O29) and
    readiness (O15).

    The router answers first: no route -> ``not_found`` (404 over HTTP), a
    route without this method -> ``method_not_allowed`` (405), whatever the
    session.  Then: public route -> ``pass``; a WebSocket without a valid
    session -> ``close_ws`` (code 4401); invalid session with an HTML accept
    -> 302 to the login page with the path (and query) as return target;
    invalid otherwise -> 401; a valid GET on ``/`` without ``force=1`` while
    the deployment is not ready -> 302 to setup; else the route's handler.
    Adds ``decision``, ``status`` (null when the handler decides) and ``location``.
    """
    q = F.coalesce(F.col("query"), F.lit(""))
    wants_html = F.coalesce(F.lower(F.col("accept")).contains("text/html"), F.lit(False))
    rt = F.when(F.length(q) > 0, F.concat(F.col("path"), F.lit("?"), q)).otherwise(F.col("path"))
    login_loc = F.concat(F.lit(C.LOGIN_PATH + "?returnTo="), quote_path(rt))
    force = F.coalesce(F.try_url_decode(query_param_last(q, "force")) == F.lit("1"), F.lit(False))
    rdy = F.coalesce(ready if ready is not None else F.col("ready"), F.lit(False))
    valid = F.coalesce(F.col("valid"), F.lit(False))
    ws = (F.col("kind") if "kind" in classified.columns else F.lit("http")) == "ws"
    decision = (
        F.when(F.col("handler").isin("method_not_allowed", "not_found"), F.col("handler"))
        .when(F.col("is_public"), F.lit("pass"))
        .when(ws & ~valid, F.lit("close_ws"))
        .when(~valid & wants_html, F.lit("redirect_login"))
        .when(~valid, F.lit("unauthorized"))
        .when((F.col("handler") == "route_root") & (F.upper("method") == "GET") & ~force & ~rdy, F.lit("redirect_setup"))
        .otherwise(F.lit("handler"))
    )
    status = (
        F.when(decision.isin("redirect_login", "redirect_setup"), F.lit(302))
        .when(decision == "unauthorized", F.lit(401))
        .when(decision == "close_ws", F.lit(4401))
        .when(F.col("handler") == "method_not_allowed", F.lit(405))
        .when(~ws & F.col("handler").isin("route_setup_404", "not_found"), F.lit(404))
    )
    location = F.when(decision == "redirect_login", login_loc).when(decision == "redirect_setup", F.lit(C.SETUP_PATH))
    return classified.withColumns({"decision": decision, "status": status, "location": location})


# ---------------------------------------------------------------------------
# O30 upstream_errors
# ---------------------------------------------------------------------------


def upstream_errors(responses: DataFrame, body: str = "body", snippet_bytes: int = C.ERROR_SNIPPET_BYTES) -> DataFrame:
    """Upstream replies worth a log line.

    Transport failures become 503 (connect) or 502 (other) with outcome
    ``unavailable`` / ``upstream_error``; a reply with status >= 400 keeps
    its status with outcome ``error_status`` and a snippet of the first
    ``snippet_bytes`` *bytes* of the body, decoded with replacement.
    """
    b = F.col(body)
    raw = b if dict(responses.dtypes).get(body) == "binary" else F.encode(b, "UTF-8")
    snippet = F.make_valid_utf8(F.substring(raw, 1, snippet_bytes).cast("string"))
    fail = F.col("failure")
    status = F.when(fail == "connect", F.lit(503)).when(fail.isNotNull(), F.lit(502)).otherwise(F.col("status"))
    outcome = (
        F.when(fail == "connect", F.lit("unavailable"))
        .when(fail.isNotNull(), F.lit("upstream_error"))
        .otherwise(F.lit("error_status"))
    )
    out = responses.withColumns({"status": status, "outcome": outcome})
    out = out.filter(fail.isNotNull() | (F.col("status") >= 400))
    return out.withColumn("snippet", F.when(fail.isNull(), snippet))
