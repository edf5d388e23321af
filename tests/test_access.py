"""Access: O9 headers, O27 routes, O29 sessions, O30 upstream errors, O35 decisions, O36 return targets."""

import datetime as dt

from gatewarden.operators import access as A

T0 = dt.datetime(2024, 1, 1)


def t(s):
    return T0 + dt.timedelta(seconds=s)


def test_scrub_headers_case_insensitive(spark):
    df = spark.createDataFrame([({"Host": "h", "TRANSFER-ENCODING": "c", "Authorization": "b", "cookie": "x"},)], "headers map<string,string>")
    assert A.scrub_headers(df).first().headers == {"Authorization": "b", "cookie": "x"}
    assert A.scrub_response_headers(
        spark.createDataFrame([({"Content-Length": "1", "content-encoding": "gz", "X": "y"},)], "headers map<string,string>")
    ).first().headers == {"X": "y"}


def test_classify_routes_cases(spark):
    rows = [
        ("http", "GET", "/setup/typo"),
        ("http", "GET", "/setup"),
        ("http", "POST", "/setup/api/config"),   # wrong method: setup catch-all 404 handler
        ("http", "GET", "/anything/else"),
        ("ws", "GET", "/anything/else"),
        ("ws", "GET", "/api/pty"),
        ("http", "GET", "/api/pty"),
        ("http", "TRACE", "/health"),
        ("http", "HEAD", "/health"),
        ("http", "POST", "/login"),
        ("http", "GET", "/"),
    ]
    df = spark.createDataFrame(rows, "kind string, method string, path string")
    got = [(r.path, r.kind, r.method, r.handler, r.is_public) for r in A.classify_routes(df).collect()]
    h = {(p, k, m): (hd, pub) for p, k, m, hd, pub in got}
    assert h[("/setup/typo", "http", "GET")] == ("route_setup_404", False)
    assert h[("/setup", "http", "GET")] == ("page_index", False)
    assert h[("/setup/api/config", "http", "POST")] == ("route_setup_404", False)
    assert h[("/anything/else", "http", "GET")] == ("route_proxy", False)
    assert h[("/anything/else", "ws", "GET")][0] == "not_found"
    assert h[("/api/pty", "ws", "GET")][0] == "ws_proxy"
    assert h[("/api/pty", "http", "GET")][0] == "route_proxy"
    assert h[("/health", "http", "TRACE")][0] == "method_not_allowed"
    assert h[("/health", "http", "HEAD")] == ("route_health", True)
    assert h[("/login", "http", "POST")] == ("login_post", True)
    assert h[("/", "http", "GET")][0] == "route_root"
    plan = A.classify_routes(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_session_validity_cases(spark):
    logins = spark.createDataFrame([("d", "s1", t(0.5)), ("d", "s2", t(100))], "deployment_id string, session_id string, ts timestamp")
    boots = spark.createDataFrame([("d", t(50))], "deployment_id string, ts timestamp")
    life = 1000
    acc = spark.createDataFrame(
        [
            ("d", "s1", t(1000.0), 1),    # expiry second: int(0.5) + 1000 = 1000 -> valid at 1000.0 ... but boot at 50
            ("d", "s0", t(10), 2),        # before any login
            ("d", "s2", t(1100), 3),      # at expiry second -> valid
            ("d", "s2", t(1100.5), 4),    # within the expiry second, still valid (compared to the whole second)
            ("d", "s2", t(1101), 5),      # one second later -> invalid
            ("d", "s1", t(20), 6),        # before the boot -> valid
        ],
        "deployment_id string, session_id string, ts timestamp, seq long",
    )
    got = {r.seq: r.valid for r in A.session_validity(acc, logins, boots, lifetime_s=life).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True}


def test_session_validity_boot_ties(spark):
    # a boot at the login's own time is before the login (same process);
    # a boot at the request's own time ends the process the token belongs to
    logins = spark.createDataFrame([("d", "s1", t(100)), ("d", "s2", t(300))], "deployment_id string, session_id string, ts timestamp")
    boots = spark.createDataFrame([("d", t(100)), ("d", t(400))], "deployment_id string, ts timestamp")
    acc = spark.createDataFrame(
        [
            ("d", "s1", t(100), 1),   # login and boot at the same time as the request -> valid
            ("d", "s1", t(399), 2),   # no boot after the login yet -> valid
            ("d", "s2", t(400), 3),   # boot at the request's time -> invalid
            ("d", "s2", t(300), 4),   # login at the request's time -> valid
        ],
        "deployment_id string, session_id string, ts timestamp, seq long",
    )
    got = {r.seq: r.valid for r in A.session_validity(acc, logins, boots, lifetime_s=10_000).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True}


def test_session_validity_matches_brute_force_across_buckets(spark):
    import random

    rnd = random.Random(7)
    deps, life = ["a", "b"], 200
    logins = [(d, f"s{rnd.randrange(3)}", rnd.randrange(0, 1000)) for d in deps for _ in range(15)]
    boots = [(d, rnd.randrange(0, 1000)) for d in deps for _ in range(6)]
    reqs = [(d, f"s{rnd.randrange(4)}", rnd.randrange(0, 1000), i) for i, d in enumerate(rnd.choice(deps) for _ in range(300))]

    def brute(d, s, ts):
        ls = [lt for ld, ls_, lt in logins if ld == d and ls_ == s and lt <= ts]
        if not ls:
            return False
        login = max(ls)
        reboot = any(ld == d and login < bt <= ts for ld, bt in boots)
        return not reboot and ts <= login + life

    want = {i: brute(d, s, ts) for d, s, ts, i in reqs}
    ldf = spark.createDataFrame([(d, s, t(x)) for d, s, x in logins], "deployment_id string, session_id string, ts timestamp")
    bdf = spark.createDataFrame([(d, t(x)) for d, x in boots], "deployment_id string, ts timestamp")
    adf = spark.createDataFrame([(d, s, t(x), i) for d, s, x, i in reqs], "deployment_id string, session_id string, ts timestamp, seq long")
    got = {r.seq: r.valid for r in A.session_validity(adf, ldf, bdf, lifetime_s=life, bucket_s=37).collect()}
    assert got == want
    assert any(want.values()) and not all(want.values())


def test_safe_return_target_cases(spark):
    vals = ["", "x", "//h", "/a?b=c", "http://h/", "/\\h", None]
    df = spark.createDataFrame([(v,) for v in vals], "return_to string")
    got = [(r.return_to, r.target, r.has_backslash) for r in A.safe_return_target(df).collect()]
    assert [g[1] for g in got] == ["/", "/", "/", "/a?b=c", "/", "/\\h", "/"]
    assert [g[2] for g in got][5] is True


def test_access_decision_cases(spark):
    df = spark.createDataFrame(
        [
            (1, "GET", "/", "", "text/html", False, True),
            (2, "GET", "/setup/api/status", "", "application/json", False, True),
            (3, "GET", "/", "force=1", "text/html", True, False),
            (4, "GET", "/", "", "text/html", True, False),
            (5, "POST", "/", "", "text/html", True, False),
            (6, "GET", "/health", "", "", False, False),
            (7, "GET", "/a b", "x=1&force=0&force=1", "TEXT/HTML", False, True),
        ],
        "seq int, method string, path string, query string, accept string, valid boolean, ready boolean",
    )
    out = A.access_decision(A.classify_routes(df))
    got = {r.seq: (r.decision, r.status, r.location) for r in out.collect()}
    assert got[1] == ("redirect_login", 302, "/login?returnTo=/")
    assert got[2] == ("unauthorized", 401, None)
    assert got[3] == ("handler", None, None)
    assert got[4] == ("redirect_setup", 302, "/setup")
    assert got[5] == ("handler", None, None)
    assert got[6] == ("pass", None, None)
    assert got[7] == ("redirect_login", 302, "/login?returnTo=/a%20b%3Fx%3D1%26force%3D0%26force%3D1")


def test_upstream_errors_cases(spark):
    body_ok = ("é" * 100).encode() + b"tail"  # 200 bytes of two-byte chars, then more
    cut = ("a" + "é" * 100).encode()            # byte 200 cuts a character
    df = spark.createDataFrame(
        [
            (1, 399, None, bytearray(b"x")),
            (2, 400, None, bytearray(body_ok)),
            (3, None, "connect", None),
            (4, None, "other", None),
            (5, 500, None, bytearray(cut)),
        ],
        "id int, status int, failure string, body binary",
    )
    got = {r.id: (r.status, r.outcome, r.snippet) for r in A.upstream_errors(df).collect()}
    assert 1 not in got
    assert got[2] == (400, "error_status", body_ok[:200].decode("utf-8", errors="replace"))
    assert got[3] == (503, "unavailable", None)
    assert got[4] == (502, "upstream_error", None)
    assert got[5][2] == cut[:200].decode("utf-8", errors="replace")


def test_token_expiry_rule(spark):
    df = spark.createDataFrame(
        [
            ("1000.abc", t(0)), ("1704067200.sig", t(0)), ("1704067200.sig", t(0.5)), ("1704067200.sig", t(1)),
            ("nodot", t(0)), ("x.y.z", t(0)), ("12.34.sig", t(0)), ("", t(0)),
        ],
        "token string, ts timestamp",
    )
    got = [(r.e, r.ok) for r in df.select(A.token_expiry("token").alias("e"), A.token_unexpired("token", "ts").alias("ok")).collect()]
    # T0 = 2024-01-01 00:00:00 = 1704067200
    assert got == [
        (1000, False), (1704067200, True), (1704067200, False), (1704067200, False),
        (None, False), (None, False), (None, False), (None, False),
    ]


def test_return_targets_hidden_hosts(spark):
    from gatewarden.operators.access import safe_return_target

    cases = {"/\t/evil.com": "/", "/\n/evil.com": "/", "/\r/evil.com": "/", "/a\tb": "/a\tb", "/\t//x": "/\t//x", "/ok?x=//y": "/ok?x=//y"}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, return_to string")
    assert {list(cases)[r.i]: r.target for r in safe_return_target(df).collect()} == cases


def _requests(spark, seed, n=1500):
    import random

    rnd = random.Random(seed)
    parts = ["setup", "api", "config", "login", "health", "plugins", "x", "", "events", "pairing", "ws", "pty", "lo", "setu", "gateway", "é"]
    paths = [r[1].replace("{path:path}", rnd.choice(["", "a", "a/b", "/"])) for r in A.C.ROUTES for _ in range(4)]
    paths += ["/" + "/".join(rnd.choice(parts) for _ in range(rnd.randint(0, 4))) for _ in range(n)] + [None, "", "no/slash", "//", "/setup//"]
    rows = [(i, rnd.choice(["http", "http", "ws", None]), rnd.choice(["GET", "get", "POST", "PUT", "DELETE", "HEAD", "TRACE", None]), p) for i, p in enumerate(paths * 3)]
    return spark.createDataFrame(rows, "id long, kind string, method string, path string")


def test_rules_table_equals_compiled_chain(spark):
    df = _requests(spark, 1)
    cols = ["id", "handler", "route_index", "is_public"]
    want = sorted(map(str, A.classify_routes(df).select(cols).collect()))
    for limit in (100_000, 3):  # broadcast, and joined in copies
        got = A.classify_routes_by_table(df, A.routes_table(spark), max_broadcast_rules=limit)
        assert sorted(map(str, got.select(cols).collect())) == want
        assert got.columns[: len(df.columns)] == df.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rules_of_ten_thousand_by_deployment(spark):
    import random

    rnd = random.Random(2)
    segs = [f"s{i}" for i in range(30)]
    rules = []
    for i in range(10_000):
        path = "/" + "/".join(rnd.choice(segs) for _ in range(rnd.randint(1, 3)))
        pattern = rnd.choice([path, path + "/{path:path}", path[:-1] + "{path:path}", path])
        rules.append((f"d{i % 7}", rnd.randrange(10**6), rnd.choice(["http", "http", "ws"]), pattern, rnd.choice([None, [], ["POST"], ["get", "PUT"]]), f"h{i}"))
    rows = [(i, f"d{rnd.randrange(8)}", rnd.choice(["http", "ws"]), rnd.choice(["GET", "HEAD", "POST", "PATCH"]), "/" + "/".join(rnd.choice(segs) for _ in range(rnd.randint(0, 5)))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, deployment_id string, kind string, method string, path string")
    table = spark.createDataFrame(rules, "deployment_id string, priority int, kind string, pattern string, methods array<string>, handler string")

    def one(dep, kind, method, path):
        fits = []
        for d, pr, k, pat, ms, h in rules:
            if d == dep and k == kind and (path.startswith(pat[: -len("{path:path}")]) if pat.endswith("{path:path}") else path == pat):
                allowed = {m.upper() for m in (ms or ["GET"])}
                allowed |= {"HEAD"} if "GET" in allowed else set()
                fits.append((pr, h, k == "ws" or method in allowed))
        full = sorted((pr, h) for pr, h, ok in fits if ok)
        if full:
            return full[0][::-1]
        return ("method_not_allowed", min(f[0] for f in fits)) if fits and kind == "http" else ("not_found", None)

    got = {r.id: (r.handler, r.route_index) for r in A.classify_routes_by_table(df, table).collect()}
    assert got == {i: one(*rest) for i, *rest in rows}
    none = A.classify_routes_by_table(df, table.limit(0)).collect()
    assert {r.handler for r in none} == {"not_found"} and len(none) == 400
