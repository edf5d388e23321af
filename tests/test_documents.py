"""Documents: O10 overlay, O31-O33 credential docs, O34 HTML injection."""

import json

from pyspark.sql import functions as F

from gatewarden.operators import documents as D


def test_overlay_config_cases(spark):
    existing = spark.createDataFrame(
        [
            ("wrong", "model", "gpt", "str"),                  # section of the wrong type
            ("wrong", "terminal.backend", "docker", "str"),
            ("wrong", "mcp_servers.x.command", "run", "str"),  # unknown section kept
            ("wrong", "agent.max_iterations", "7", "int"),     # default already present
            ("wrong", "custom_providers", "[]", "list"),       # removed block
            ("wrong", "data_dir.sub", "x", "str"),             # subtree under a forced scalar
        ],
        "deployment_id string, path string, value string, value_type string",
    )
    policy = spark.createDataFrame(
        [
            ("wrong", "model.default", "m", "force", "str"),
            ("wrong", "terminal.backend", "local", "force", "str"),
            ("wrong", "agent.max_iterations", "50", "default", "int"),
            ("wrong", "data_dir", "/data", "force", "str"),
            ("wrong", "custom_providers", None, "remove", "list"),
            ("missing", "agent.max_iterations", "50", "default", "int"),
        ],
        "deployment_id string, path string, value string, policy string, value_type string",
    )
    got = sorted(tuple(r) for r in D.overlay_config(existing, policy).collect())
    assert got == sorted(
        [
            ("wrong", "model.default", "m", "str"),
            ("wrong", "terminal.backend", "local", "str"),
            ("wrong", "mcp_servers.x.command", "run", "str"),
            ("wrong", "agent.max_iterations", "7", "int"),
            ("wrong", "data_dir", "/data", "str"),
            ("missing", "agent.max_iterations", "50", "int"),
        ]
    )
    # idempotent
    again = D.overlay_config(D.overlay_config(existing, policy), policy)
    assert sorted(tuple(r) for r in again.collect()) == got


def test_overlay_policy_from_settings(spark):
    s = spark.createDataFrame(
        [("a", "LLM_MODEL", "m"), ("a", "DEEPSEEK_API_KEY", "k"), ("a", "CUSTOM_PROVIDER_BASE_URL", "https://h/v1"), ("b", "LLM_MODEL", "")],
        "deployment_id string, key string, value string",
    )
    pol = {(r.deployment_id, r.path): (r.value, r.policy) for r in D.overlay_policy_from_settings(s, "/data").collect()}
    assert pol[("a", "model.provider")] == ("auto", "force")
    assert ("b", "model.provider") not in pol
    assert pol[("b", "model.default")] == ("", "force")
    assert pol[("b", "custom_providers")][1] == "remove"
    assert json.loads(pol[("a", "custom_providers")][0]) == [{"name": "https---h-v1", "base_url": "https://h/v1", "key_env": "CUSTOM_PROVIDER_API_KEY"}]


DOCS = [
    ("good", json.dumps({"providers": {"xai-oauth": {"tokens": {"refresh_token": "r"}}, "o": {}}, "active_provider": "xai-oauth", "x": 1})),
    ("notjson", "{nope"),
    ("wrongtype", json.dumps({"providers": {"xai-oauth": {"tokens": ["r"]}}})),
    ("falsy", json.dumps({"providers": {"xai-oauth": {"tokens": {"refresh_token": ""}}}})),
    ("other_active", json.dumps({"providers": {"xai-oauth": {}, "o": {}}, "active_provider": "o"})),
]


def test_credential_presence(spark):
    docs = spark.createDataFrame(DOCS, "deployment_id string, doc string")
    got = {r.deployment_id: r.has_refresh_token for r in D.credential_presence(docs).collect()}
    assert got == {"good": True, "notjson": False, "wrongtype": False, "falsy": False, "other_active": False}


def test_remove_provider(spark):
    docs = spark.createDataFrame(DOCS, "deployment_id string, doc string")
    out = {r.deployment_id: r.doc for r in D.remove_provider(docs, "xai-oauth").collect()}
    good = json.loads(out["good"])
    assert good["providers"] == {"o": {}} and "active_provider" not in good and good["x"] == 1
    other = json.loads(out["other_active"])
    assert other["active_provider"] == "o" and list(other["providers"]) == ["o"]
    assert out["notjson"] == "{nope"


def test_upsert_provider(spark):
    docs = spark.createDataFrame(DOCS, "deployment_id string, doc string")
    tokens = F.struct(F.lit("a").alias("access_token"), F.lit("r2").alias("refresh_token"))
    out = {r.deployment_id: json.loads(r.doc) for r in D.upsert_provider(docs, "xai-oauth", tokens, F.lit("2024-05-01 10:00:00")).collect()}
    g = out["good"]
    assert g["active_provider"] == "xai-oauth" and g["version"] == 2 and g["updated_at"] == "2024-05-01T10:00:00Z"
    assert g["providers"]["xai-oauth"]["tokens"] == {"access_token": "a", "refresh_token": "r2"}
    assert g["providers"]["xai-oauth"]["auth_mode"] == "oauth_device" and "o" in g["providers"] and g["x"] == 1
    assert out["notjson"]["providers"]["xai-oauth"]["last_refresh"] == "2024-05-01T10:00:00Z"


def test_inject_html_cases(spark):
    pages = spark.createDataFrame(
        [
            (1, "<html><body>a</body><body>b</body></html>", "text/html; charset=utf-8"),
            (2, "<html>no tag</html>", "text/html"),
            (3, "<html><BODY>x</BODY></html>", "TEXT/HTML"),
            (4, "<body>x</body>", "application/json"),
        ],
        "page_id long, html string, ct string",
    )
    got = {r.page_id: (r.html, r.injected) for r in D.inject_html(pages, "<W>", content_type="ct").collect()}
    assert got[1] == ("<html><body>a<W></body><body>b</body></html>", True)
    assert got[2] == ("<html>no tag</html>", False)
    assert got[3] == ("<html><BODY>x</BODY></html>", False)
    assert got[4] == ("<body>x</body>", False)


def test_remove_provider_leaves_wrong_types_alone(spark):
    docs = spark.createDataFrame(
        [
            ("list", '{"providers": [], "active_provider": "p"}'),
            ("null", '{"providers": null, "active_provider": "p"}'),
            ("none", '{"active_provider": "p"}'),
            ("both", '{"providers": {"p": {}, "q": {}}, "active_provider": "p"}'),
        ],
        "deployment_id string, doc string",
    )
    got = {r.deployment_id: r.doc for r in D.remove_provider(docs, "p").collect()}
    assert got["list"] == docs.filter("deployment_id = 'list'").first().doc and '"active_provider"' in got["null"]
    assert got["none"] == "{}" and got["both"] == '{"providers":{"q":{}}}'
    s = spark.createDataFrame([("d", "_MODEL_XAI_OAUTH", "m"), ("d", "LLM_MODEL", "m")], "deployment_id string, key string, value string")
    assert [r.key for r in D.drop_provider_model(s, "xai-oauth").collect()] == ["LLM_MODEL"]


def test_last_of_equal_json_keys_counts(spark):
    doc = '{"providers": {"xai-oauth": {"tokens": {"refresh_token": ""}}}, "providers": {"xai-oauth": {"tokens": {"refresh_token": "x"}}}}'
    df = spark.createDataFrame([("d", doc)], "deployment_id string, doc string")
    assert D.credential_presence(df).first().has_refresh_token is True


def test_document_leaves_of_any_depth(spark):
    deep, path = "1", "$"
    for i in range(12):
        deep, path = '{"k%d": %s, "t": "}{\\"{"}' % (11 - i, deep), path + f".k{i}"
    docs = spark.createDataFrame(
        [("deep", deep), ("flat", '{"a": [1, {"b": 2}], "e": {}, "n": null, "s": "x"}'), ("empty", "{}"), ("list", "[1]"), ("bad", "{{{{"), ("none", None)],
        "deployment_id string, doc string",
    )
    got = {}
    for r in D.document_leaves(docs).collect():
        got.setdefault(r.deployment_id, {})[r.path] = r.value
    assert got["deep"][path] == "1" and len(got["deep"]) == 13 and got["deep"]["$.k0.t"] == '}{"{'
    assert got["flat"] == {"$.a": '[1,{"b":2}]', "$.e": "{}", "$.n": None, "$.s": "x"}
    assert got["empty"] == {"$": "{}"} and got["list"] == {"$": "[1]"} and got["bad"] == {"$": "{{{{"} and got["none"] == {"$": None}
    plan = D.document_leaves(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Exchange" not in plan
