"""Fixed values.

Everything in this module must equal the values the supervised gateway uses
for results to agree: the settings registry, channel map, category order and
titles, header names, limits.  They are stated plainly, in their natural
order.  Nothing here grows with the data: the registry has 58 rows, the channel map
7, the category list 15 (+ "other").
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the reference's, do not edit.
# ---------------------------------------------------------------------------

# Settings registry: (key, label, category, is_secret), in registry order.
REGISTRY: list[tuple[str, str, str, bool]] = [
    ("LLM_MODEL", "Model", "model", False),
    ("OPENROUTER_API_KEY", "OpenRouter", "provider", True),
    ("DEEPSEEK_API_KEY", "DeepSeek", "provider", True),
    ("DASHSCOPE_API_KEY", "Qwen Cloud (DashScope)", "provider", True),
    ("GLM_API_KEY", "GLM / Z.AI", "provider", True),
    ("KIMI_API_KEY", "Kimi", "provider", True),
    ("MINIMAX_API_KEY", "MiniMax", "provider", True),
    ("HF_TOKEN", "Hugging Face", "provider", True),
    ("NVIDIA_API_KEY", "NVIDIA NIM", "provider", True),
    ("ARCEEAI_API_KEY", "Arcee AI", "provider", True),
    ("STEPFUN_API_KEY", "Step Plan", "provider", True),
    ("GEMINI_API_KEY", "Google AI Studio", "provider", True),
    ("NOVITA_API_KEY", "NovitaAI", "provider", True),
    ("FIREWORKS_API_KEY", "Fireworks AI", "provider", True),
    ("ANTHROPIC_API_KEY", "Anthropic (Claude)", "provider", True),
    ("XAI_API_KEY", "xAI", "provider", True),
    ("AWS_ACCESS_KEY_ID", "AWS Access Key ID", "provider", True),
    ("AWS_SECRET_ACCESS_KEY", "AWS Secret Access Key", "bedrock", True),
    ("AWS_DEFAULT_REGION", "AWS Region", "bedrock", False),
    ("COPILOT_GITHUB_TOKEN", "GitHub Copilot", "provider", True),
    ("GMI_API_KEY", "GMI Cloud", "provider", True),
    ("OPENCODE_ZEN_API_KEY", "OpenCode Zen", "provider", True),
    ("OPENCODE_GO_API_KEY", "OpenCode Go", "provider", True),
    ("KILOCODE_API_KEY", "Kilo Code", "provider", True),
    ("OLLAMA_API_KEY", "Ollama Cloud", "provider", True),
    ("AZURE_FOUNDRY_API_KEY", "Azure Foundry key", "provider", True),
    ("AZURE_FOUNDRY_BASE_URL", "Azure Foundry URL", "azure", False),
    ("CUSTOM_PROVIDER_API_KEY", "Custom Provider key", "provider", True),
    ("CUSTOM_PROVIDER_BASE_URL", "Custom Provider base URL", "custom", False),
    ("CUSTOM_PROVIDER_NAME", "Custom Provider name", "custom", False),
    ("PARALLEL_API_KEY", "Parallel (search)", "tool", True),
    ("FIRECRAWL_API_KEY", "Firecrawl (scrape)", "tool", True),
    ("TAVILY_API_KEY", "Tavily (search)", "tool", True),
    ("FAL_KEY", "FAL (image gen)", "tool", True),
    ("BROWSERBASE_API_KEY", "Browserbase key", "tool", True),
    ("BROWSERBASE_PROJECT_ID", "Browserbase project", "tool", False),
    ("GITHUB_TOKEN", "GitHub token", "tool", True),
    ("VOICE_TOOLS_OPENAI_KEY", "OpenAI (voice/TTS)", "tool", True),
    ("HONCHO_API_KEY", "Honcho (memory)", "tool", True),
    ("TELEGRAM_BOT_TOKEN", "Bot Token", "telegram", True),
    ("TELEGRAM_ALLOWED_USERS", "Allowed User IDs", "telegram", False),
    ("DISCORD_BOT_TOKEN", "Bot Token", "discord", True),
    ("DISCORD_ALLOWED_USERS", "Allowed User IDs", "discord", False),
    ("SLACK_BOT_TOKEN", "Bot Token (xoxb-...)", "slack", True),
    ("SLACK_APP_TOKEN", "App Token (xapp-...)", "slack", True),
    ("WHATSAPP_ENABLED", "Enable WhatsApp", "whatsapp", False),
    ("EMAIL_ADDRESS", "Email Address", "email", False),
    ("EMAIL_PASSWORD", "Email Password", "email", True),
    ("EMAIL_IMAP_HOST", "IMAP Host", "email", False),
    ("EMAIL_SMTP_HOST", "SMTP Host", "email", False),
    ("MATTERMOST_URL", "Server URL", "mattermost", False),
    ("MATTERMOST_TOKEN", "Bot Token", "mattermost", True),
    ("MATRIX_HOMESERVER", "Homeserver URL", "matrix", False),
    ("MATRIX_ACCESS_TOKEN", "Access Token", "matrix", True),
    ("MATRIX_USER_ID", "User ID", "matrix", False),
    ("GATEWAY_ALLOW_ALL_USERS", "Allow all users", "gateway", False),
    ("ADMIN_USERNAME", "Admin username", "admin", False),
    ("ADMIN_PASSWORD", "Admin password", "admin", True),
]

# Channel name -> settings key, in display order.
CHANNELS: list[tuple[str, str]] = [
    ("Telegram", "TELEGRAM_BOT_TOKEN"),
    ("Discord", "DISCORD_BOT_TOKEN"),
    ("Slack", "SLACK_BOT_TOKEN"),
    ("WhatsApp", "WHATSAPP_ENABLED"),
    ("Email", "EMAIL_ADDRESS"),
    ("Mattermost", "MATTERMOST_TOKEN"),
    ("Matrix", "MATRIX_ACCESS_TOKEN"),
]

# .env rendering: category order and the header title of each group.
CATEGORIES: list[tuple[str, str]] = [
    ("model", "Model"),
    ("provider", "Providers"),
    ("bedrock", "AWS Bedrock"),
    ("azure", "Azure Foundry"),
    ("custom", "Custom Endpoint"),
    ("tool", "Tools"),
    ("telegram", "Telegram"),
    ("discord", "Discord"),
    ("slack", "Slack"),
    ("whatsapp", "WhatsApp"),
    ("email", "Email"),
    ("mattermost", "Mattermost"),
    ("matrix", "Matrix"),
    ("gateway", "Gateway"),
    ("admin", "Admin"),
]
OTHER_CATEGORY = ("other", "Other")  # always rendered last

# Values read as "off" by the channel rule (compared in lower case).
FALSE_WORDS = ("false", "0", "no")

# Request headers dropped on the way in; response headers additionally drop
# the two length/encoding headers.  Compared in lower case.
HOP_BY_HOP = ("host", "transfer-encoding")
RESPONSE_EXTRA_DROP = ("content-encoding", "content-length")

# Limits (defaults of the operators).
PAIRING_TTL_S = 3600
CRASH_WINDOW_S = 120
CRASH_MAX_EXITS = 5
RESPAWN_BASE_DELAY_S = 2.0
RESPAWN_MAX_DELAY_S = 30.0
GATEWAY_LOG_LINES = 500
SESSION_LIFETIME_S = 7 * 86400
DEVICE_FLOW_LIFE_S = 900
DEVICE_FLOW_MIN_INTERVAL_S = 5
DEVICE_FLOW_SLOWDOWN_STEP_S = 5
DEVICE_FLOW_MAX_INTERVAL_S = 30
MASK_PREFIX_CHARS = 8
MASK_SUFFIX = "***"
ERROR_SNIPPET_BYTES = 200
DEFAULT_MAX_ITERATIONS = 50
CUSTOM_KEY_ENV = "CUSTOM_PROVIDER_API_KEY"
MODEL_KEY = "LLM_MODEL"
# Forced terminal leaves of the config overlay.
TERMINAL_DEFAULTS: list[tuple[str, str]] = [
    ("terminal.backend", "local"),
    ("terminal.timeout", "60"),
    ("terminal.cwd", "/tmp"),
]
DEVICE_FLOW_TERMINAL_ERROR = "Unknown error"
DEVICE_FLOW_BAD_BODY_ERROR = "Invalid token response from xAI"

# Route table in match order: (kind, path pattern, methods, handler).
# ``None`` methods = GET only (HEAD implied); ``{path:path}`` matches any rest.
ANY_METHOD = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
ROUTES: list[tuple[str, str, tuple[str, ...] | None, str]] = [
    ("http", "/health", None, "route_health"),
    ("http", "/login", ("GET",), "page_login"),
    ("http", "/login", ("POST",), "login_post"),
    ("http", "/logout", None, "logout"),
    ("http", "/setup", None, "page_index"),
    ("http", "/setup/", None, "page_index"),
    ("http", "/setup/api/config", ("GET",), "api_config_get"),
    ("http", "/setup/api/config", ("PUT",), "api_config_put"),
    ("http", "/setup/api/status", None, "api_status"),
    ("http", "/setup/api/logs", None, "api_logs"),
    ("http", "/setup/api/gateway/start", ("POST",), "api_gw_start"),
    ("http", "/setup/api/gateway/stop", ("POST",), "api_gw_stop"),
    ("http", "/setup/api/gateway/restart", ("POST",), "api_gw_restart"),
    ("http", "/setup/api/config/reset", ("POST",), "api_config_reset"),
    ("http", "/setup/api/pairing/pending", None, "api_pairing_pending"),
    ("http", "/setup/api/pairing/approve", ("POST",), "api_pairing_approve"),
    ("http", "/setup/api/pairing/deny", ("POST",), "api_pairing_deny"),
    ("http", "/setup/api/pairing/approved", None, "api_pairing_approved"),
    ("http", "/setup/api/pairing/revoke", ("POST",), "api_pairing_revoke"),
    ("http", "/setup/api/oauth/xai/start", ("POST",), "api_oauth_xai_start"),
    ("http", "/setup/api/oauth/xai/status", None, "api_oauth_xai_status"),
    ("http", "/setup/api/oauth/xai", ("DELETE",), "api_oauth_xai_delete"),
    ("http", "/setup/{path:path}", ANY_METHOD, "route_setup_404"),
    ("ws", "/api/pty", None, "ws_proxy"),
    ("ws", "/api/ws", None, "ws_proxy"),
    ("ws", "/api/events", None, "ws_proxy"),
    ("ws", "/api/plugins/{path:path}", None, "ws_proxy"),
    ("http", "/", ANY_METHOD, "route_root"),
    ("http", "/{path:path}", ANY_METHOD, "route_proxy"),
]
# Handlers that run without the session check.
PUBLIC_HANDLERS = ("route_health", "page_login", "login_post", "logout")
LOGIN_PATH = "/login"
SETUP_PATH = "/setup"
