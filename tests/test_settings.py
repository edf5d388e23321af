"""Settings jobs: O1, O14, O4, O7, O11-O13, O15, O18, O25, O28 goldens (FIXTURES.md §2)."""

from gatewarden.operators import settings as S
from gatewarden.sources.dotenv import parse_dotenv


def settings_df(spark, rows):
    return spark.createDataFrame(rows, "deployment_id string, key string, value string")


def test_parse_dotenv_goldens(spark):
    text = "\n".join(
        [
            "",
            "# c",
            "novalue",
            "=x",
            "A=1=2",
            ' A = "q" ',
            'B="',
            "C='x\"",
            "export D=1",
            "\tE=tab\xa0",
            "F=crlf\r",
            "G=ff\x0cH=after-ff",
        ]
    )
    files = spark.createDataFrame([("d", ".env", text)], "deployment_id string, path string, text string")
    got = [(r.line_no, r.key, r.value) for r in parse_dotenv(files).orderBy("line_no").collect()]
    assert got == [
        (4, "", "x"),
        (5, "A", "1=2"),
        (6, "A", "q"),
        (7, "B", '"'),
        (8, "C", "'x\""),
        (9, "export D", "1"),
        (10, "E", "tab"),
        (11, "F", "crlf"),
        (12, "G", "ff"),
        (13, "H", "after-ff"),
    ]


def test_effective_last_line_wins(spark):
    files = spark.createDataFrame([("d", ".env", "A=1\nA=2")], "deployment_id string, path string, text string")
    got = S.effective_settings(parse_dotenv(files)).collect()
    assert [(r.key, r.value) for r in got] == [("A", "2")]


def test_mask_lengths(spark):
    s = settings_df(
        spark,
        [("d", "OPENROUTER_API_KEY", v) for v in ["", "x", "12345678", "123456789"]]
        + [("d", "LLM_MODEL", "plain-model-name"), ("d", "MY_SECRET", "abcdefghijk")],
    )
    got = sorted((r.key, r.value) for r in S.mask_settings(s).collect())
    assert got == sorted(
        [
            ("OPENROUTER_API_KEY", ""),
            ("OPENROUTER_API_KEY", "***"),
            ("OPENROUTER_API_KEY", "***"),
            ("OPENROUTER_API_KEY", "12345678***"),
            ("LLM_MODEL", "plain-model-name"),
            ("MY_SECRET", "abcdefghijk"),
        ]
    )


def test_apply_masked_update(spark):
    existing = settings_df(
        spark,
        [("d", "OPENROUTER_API_KEY", "sk-real-secret"), ("d", "LLM_MODEL", "m1"), ("d", "KEEP", "k"), ("d", "TELEGRAM_BOT_TOKEN", "t")],
    )
    new = settings_df(
        spark,
        [
            ("d", "OPENROUTER_API_KEY", "sk-real-***"),   # masked secret keeps the stored value
            ("d", "DEEPSEEK_API_KEY", "abc***"),          # masked secret without a stored value -> empty -> dropped
            ("d", "MATRIX_USER_ID", "@u***"),             # non-secret ending in *** is taken literally
            ("d", "TELEGRAM_BOT_TOKEN", ""),              # empty value deletes
            ("d", "LLM_MODEL", "m2"),
        ],
    )
    got = sorted((r.key, r.value) for r in S.apply_masked_update(new, existing).collect())
    assert got == [("KEEP", "k"), ("LLM_MODEL", "m2"), ("MATRIX_USER_ID", "@u***"), ("OPENROUTER_API_KEY", "sk-real-secret")]


def test_apply_empty_update_is_identity(spark):
    existing = settings_df(spark, [("d", "A", "1"), ("d", "OPENROUTER_API_KEY", "s"), ("e", "B", "2")])
    empty = settings_df(spark, [])
    assert sorted(map(tuple, S.apply_masked_update(empty, existing).collect())) == sorted(map(tuple, existing.collect()))


def test_layer_settings_file_wins(spark):
    layers = spark.createDataFrame(
        [("d", 0, "A", "env"), ("d", 1, "A", "home"), ("d", 2, "A", "file"), ("d", 0, "B", "env")],
        "deployment_id string, priority int, key string, value string",
    )
    got = sorted((r.key, r.value) for r in S.layer_settings(layers).collect())
    assert got == [("A", "file"), ("B", "env")]


def test_render_dotenv_golden(spark):
    s = settings_df(
        spark,
        [
            ("d", "TAVILY_API_KEY", "t"),
            ("d", "A", "1"),
            ("d", "A1", "2"),
            ("d", "A_B", "3"),
            ("d", "LLM_MODEL", "m"),
            ("d", "EMPTY", ""),
            ("e", "EMPTY", ""),
        ],
    )
    got = {r.deployment_id: r.text for r in S.render_dotenv(s).collect()}
    assert got["d"] == "# Model\nLLM_MODEL=m\n\n# Tools\nTAVILY_API_KEY=t\n\n# Other\nA1=2\nA=1\nA_B=3\n"
    assert got["e"] == ""  # emptied, not gone


def test_render_whole_files(spark):
    """Categories in their order, entries in theirs, a header and a blank line each."""
    s = settings_df(
        spark,
        [
            ("d1", "X_2", "w=1"), ("d1", "TELEGRAM_BOT_TOKEN", "t"), ("d1", "XAI_API_KEY", "x"), ("d1", "DEEPSEEK_API_KEY", "k"),
            ("d1", "LLM_MODEL", "m"), ("d1", "X1", ""), ("d2", "ADMIN_PASSWORD", "p"), ("d2", "x", "1"), ("d2", "X1", "2"),
            ("d3", "LLM_MODEL", ""),
        ],
    )
    got = {r.deployment_id: r.text for r in S.render_dotenv(s).collect()}
    assert got == {
        "d1": "# Model\nLLM_MODEL=m\n\n# Providers\nDEEPSEEK_API_KEY=k\nXAI_API_KEY=x\n\n# Telegram\nTELEGRAM_BOT_TOKEN=t\n\n# Other\nX_2=w=1\n",
        "d2": "# Admin\nADMIN_PASSWORD=p\n\n# Other\nX1=2\nx=1\n",
        "d3": "",
    }


def test_readiness_cases(spark):
    deps = spark.createDataFrame([(d,) for d in ["model_only", "provider_only", "rt_only", "model_rt", "model_provider", "nothing"]], "deployment_id string")
    s = settings_df(
        spark,
        [
            ("model_only", "LLM_MODEL", "m"),
            ("provider_only", "DEEPSEEK_API_KEY", "k"),
            ("model_rt", "LLM_MODEL", "m"),
            ("model_provider", "LLM_MODEL", "m"),
            ("model_provider", "AWS_ACCESS_KEY_ID", "id"),
        ],
    )
    rt = spark.createDataFrame([("rt_only", True), ("model_rt", True)], "deployment_id string, has_refresh_token boolean")
    got = {r.deployment_id: r.ready for r in S.readiness(deps, s, rt).collect()}
    assert got == {"model_only": False, "provider_only": False, "rt_only": False, "model_rt": True, "model_provider": True, "nothing": False}


def test_first_configured_registry_order(spark):
    s = settings_df(spark, [("d", "XAI_API_KEY", "x"), ("d", "DEEPSEEK_API_KEY", "y"), ("d", "OPENROUTER_API_KEY", "")])
    assert [(r.key, r.value) for r in S.first_configured(s).collect()] == [("DEEPSEEK_API_KEY", "y")]


def test_integration_status(spark):
    deps = spark.createDataFrame([("d",)], "deployment_id string")
    s = settings_df(
        spark,
        [("d", "WHATSAPP_ENABLED", "No"), ("d", "EMAIL_ADDRESS", "off"), ("d", "TELEGRAM_BOT_TOKEN", ""), ("d", "HF_TOKEN", "h")],
    )
    got = {(r.kind, r.name): r.configured for r in S.integration_status(deps, s).collect()}
    assert got[("channel", "WhatsApp")] is False
    assert got[("channel", "Email")] is True
    assert got[("channel", "Telegram")] is False
    assert got[("provider", "Hf")] is True
    assert len(got) == 24 + 7


def test_custom_endpoints(spark):
    s = settings_df(
        spark,
        [
            ("blank", "CUSTOM_PROVIDER_BASE_URL", "   "),
            ("named", "CUSTOM_PROVIDER_BASE_URL", " https://x.example/v1 "),
            ("named", "CUSTOM_PROVIDER_NAME", " My Fancy  LLM "),
            ("symbols", "CUSTOM_PROVIDER_BASE_URL", "http://h"),
            ("symbols", "CUSTOM_PROVIDER_NAME", "!!!"),
            ("noname", "CUSTOM_PROVIDER_BASE_URL", "https://Host.Example/v1"),
        ],
    )
    got = {r.deployment_id: (r.name, r.base_url) for r in S.custom_endpoints(s).collect()}
    assert got == {
        "named": ("my-fancy--llm", "https://x.example/v1"),
        "symbols": ("custom", "http://h"),
        "noname": ("https---host-example-v1", "https://Host.Example/v1"),
    }


def test_categorise(spark):
    s = settings_df(spark, [("d", "SLACK_APP_TOKEN", "x"), ("d", "UNKNOWN", "y")])
    got = {r.key: (r.category, r.is_secret) for r in S.categorise_settings(s).collect()}
    assert got == {"SLACK_APP_TOKEN": ("slack", True), "UNKNOWN": ("other", False)}
    plan = S.categorise_settings(s)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # registry lookups are compiled maps, not joins


def test_render_lines_equal_render_text(spark):
    import random

    from gatewarden.functions import constants as C

    rnd = random.Random(4)
    keys = [k for k, *_ in C.REGISTRY] + ["X1", "X_2", "x"]
    rows = [(f"d{i}", k, rnd.choice(["", "v", "w=1"])) for i in range(6) for k in rnd.sample(keys, 15)]
    s = settings_df(spark, rows)
    lines = S.render_dotenv_lines(s).collect()
    by = {}
    for r in lines:
        by.setdefault(r.deployment_id, []).append((r.cat_ord, r.part, r.line))
    got = {d: "".join(line + "\n" for _, _, line in sorted(v)) for d, v in by.items()}
    assert all(v == "\n" or v.startswith("# ") for v in got.values())
    got = {d: "" if v == "\n" else v for d, v in got.items()}
    assert got == {r.deployment_id: r.text for r in S.render_dotenv(s).collect()}
