"""Fixed values the results depend on: rule ids, labels, weights, messages.

Nothing in this module is logic. Every table below is a set of constants that
must hold exactly these values for the output of a scan to be right.
"""

from __future__ import annotations

from typing import NamedTuple

# --- risk levels -----------------------------------------------------------

RISK_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
DECISION_RANK = {"safe": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITY_BY_RANK = ["none", "low", "medium", "high", "critical"]

RISK_MESSAGE = {
    "critical": "外部へ送る前に必ず安全化したい情報です。",
    "high": "外部へ送る前に強く確認したい情報です。",
    "medium": "文脈によっては注意が必要な情報です。",
    "low": "必要に応じて確認したい情報です。",
}
RISK_LABEL = {"critical": "重大", "high": "高", "medium": "中", "low": "低"}
DECISION_LABEL = {"safe": "安全寄り", "low": "低", "medium": "中", "high": "高", "critical": "重大"}


# --- bundled rule catalogue, in its published order ------------------------


class Rule(NamedTuple):
    id: str
    label: str
    risk_level: str
    prefix: str
    category: str


RULES = [
    Rule("email", "メールアドレス", "high", "EMAIL", "email"),
    Rule("phone", "日本の電話番号", "high", "PHONE", "phone"),
    Rule("jwt", "JWT", "high", "JWT", "secret"),
    Rule("aws_access_key", "AWS Access Key風文字列", "high", "AWS_KEY", "secret"),
    Rule("github_token", "GitHub token風文字列", "high", "GITHUB_TOKEN", "secret"),
    Rule("slack_token", "Slack token風文字列", "high", "SLACK_TOKEN", "secret"),
    Rule("stripe_secret_key", "Stripe secret key風文字列", "high", "STRIPE_KEY", "secret"),
    Rule("openai_api_key", "OpenAI API key風文字列", "high", "OPENAI_API_KEY", "secret"),
    Rule("npm_token", "npm token風文字列", "high", "NPM_TOKEN", "secret"),
    Rule("oauth_client_secret", "OAuth client secret風文字列", "high", "OAUTH_CLIENT_SECRET", "secret"),
    Rule("webhook_url", "Webhook URL風文字列", "high", "WEBHOOK_URL", "secret"),
    Rule("private_key", "秘密鍵", "high", "PRIVATE_KEY", "secret"),
    Rule("env_secret", ".env形式の秘密情報", "high", "ENV_SECRET", "secret"),
    Rule("basic_auth_url", "Basic認証情報を含むURL", "high", "BASIC_AUTH_URL", "secret"),
    Rule("database_url", "DATABASE_URL風接続文字列", "high", "DATABASE_URL", "secret"),
    Rule("credit_card", "クレジットカード風番号", "high", "CARD", "financial"),
    Rule("my_number", "マイナンバー風文字列", "high", "MY_NUMBER", "id"),
    Rule("url", "URL", "medium", "URL", "url"),
    Rule("ip_address", "IPv4アドレス", "medium", "IP_ADDRESS", "id"),
    Rule("amount", "金額", "medium", "AMOUNT", "financial"),
    Rule("confidential_text", "社外秘・注意語を含む文", "medium", "CONFIDENTIAL_TEXT", "other"),
    Rule("internal_url", "社内URLっぽいもの", "medium", "INTERNAL_URL", "url"),
    Rule("date", "日付", "low", "DATE", "date"),
    Rule("postal_code", "郵便番号", "low", "POSTAL_CODE", "address"),
    Rule("long_id", "長いID風文字列", "low", "ID", "id"),
]
RULE_IDS = [r.id for r in RULES]
RULE_BY_ID = {r.id: r for r in RULES}

# Rules that trip the secret guard; all secret-category rules plus these two.
GUARD_EXTRA_RULE_IDS = ["my_number", "credit_card"]

# Confidence of a rule hit; 0.95 unless listed.
DEFAULT_RULE_CONFIDENCE = 0.95
RULE_CONFIDENCE = {"my_number": 0.85, "confidential_text": 0.9}

# Category of findings that come from context candidates. Location, facility,
# product and event names have no entry and count as "other".
CONTEXT_CATEGORY_BY_RULE_ID = {
    "llm:person_name": "person",
    "llm:company_name": "organization",
    "llm:customer_name": "organization",
    "llm:project_name": "other",
    "llm:contract_info": "legal",
    "llm:hr_info": "hr",
    "llm:legal_info": "legal",
    "llm:financial_info": "financial",
    "llm:internal_info": "other",
    "llm:confidential_context": "other",
}
CATEGORY_BY_RULE_ID = {**{r.id: r.category for r in RULES}, **CONTEXT_CATEGORY_BY_RULE_ID}

# --- categories: score weight, generalized label, group label --------------

CATEGORIES = [
    "person", "organization", "address", "email", "phone", "id", "secret", "financial",
    "medical", "hr", "legal", "date", "url", "file", "other",
]
CATEGORY_WEIGHT = {
    "person": 0, "organization": 5, "address": 0, "email": 10, "phone": 0, "id": 10, "secret": 30,
    "financial": 20, "medical": 20, "hr": 20, "legal": 20, "date": 5, "url": 0, "file": 10, "other": 0,
}
GENERALIZED_LABEL = {
    "person": "[人名]", "organization": "[組織名]", "address": "[住所]", "email": "[メールアドレス]",
    "phone": "[電話番号]", "id": "[ID]", "secret": "[秘密情報]", "financial": "[金額情報]",
    "medical": "[医療情報]", "hr": "[人事情報]", "legal": "[法務情報]", "date": "[日付]",
    "url": "[URL]", "file": "[ファイル情報]", "other": "[注意情報]",
}
REDACTED_LABEL = "[削除済み]"
CATEGORY_GROUP_LABEL = {
    "person": "人名", "organization": "組織名・会社名", "address": "住所", "email": "メールアドレス",
    "phone": "電話番号", "id": "ID・識別子", "secret": "秘密情報", "financial": "金額・金融情報",
    "medical": "医療情報", "hr": "採用・人事情報", "legal": "契約・法務情報", "date": "日付",
    "url": "URL", "file": "ファイル情報", "other": "その他の注意情報",
}

# --- score and policy ------------------------------------------------------

PAIR_BONUS = 15
SCORE_CAP = 100
GUARD_REASON_PREFIX = "秘密情報保護の対象: "
PERSON_ADDRESS_REASON = "人名候補と住所候補が同時に含まれています。"
PERSON_PHONE_REASON = "人名候補と電話番号が同時に含まれています。"
POLICY_REASON = {
    "sanitize_required": "高リスクまたは秘密情報保護の対象が含まれるため、安全化が必要です。",
    "confirm": "送信前に詳細確認が必要な候補があります。",
    "allow": "そのまま送信できる範囲の判定です。",
}

# --- risk meter of the report ----------------------------------------------

METER_WEIGHT = {"critical": 42, "high": 34, "medium": 18, "low": 8}
METER_STATUS_LABEL = {"empty": "未検出", "sanitize": "要安全化", "confirm": "確認推奨", "low": "低リスク"}
METER_STATUS_TEXT = {
    "empty": "検出を実行すると、リスクとカテゴリがここに表示されます。",
    "sanitize": "秘密情報や個人情報の可能性があります。送る前に対象を確認してください。",
    "confirm": "文脈によって注意が必要な情報があります。必要なものだけ残せます。",
    "low": "大きな注意候補は見つかっていませんが、安全を保証するものではありません。",
}

# --- files -----------------------------------------------------------------

TEXT_EXTENSIONS = [
    "txt", "md", "csv", "json", "yaml", "yml", "env", "log",
    "js", "ts", "py", "go", "rb", "java", "html", "xml",
]
BINARY_EXTENSIONS = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "png", "jpg", "jpeg", "gif", "webp", "heic", "bmp",
]

# --- sites -----------------------------------------------------------------

SITE_BY_HOST = {
    "chatgpt.com": "chatgpt",
    "chat.openai.com": "openai_chat",
    "claude.ai": "claude",
    "gemini.google.com": "gemini",
    "www.perplexity.ai": "perplexity",
    "perplexity.ai": "perplexity",
}
SITE_IDS = ["chatgpt", "openai_chat", "claude", "gemini", "perplexity"]

# --- settings --------------------------------------------------------------

SETTINGS_VERSION = 4
SETTINGS_MESSAGE = {
    "version": "設定バージョンが古いか不正です。現在の形式に補完されます。",
    "sites": "対象サイト設定に不足があります。不足分は初期値で補完されます。",
    "rules": "検出ルール設定に不足があります。不足分は初期値で補完されます。",
    "mode": "AI文脈チェックの実行モードが不正です。手動実行または自動実行を選んでください。",
}

# --- rule bundles ----------------------------------------------------------

BUNDLE_SCHEMA_VERSION = 1
BUNDLE_SIGNATURE_ALG = "ECDSA-P256-SHA256"
BUNDLE_MAX_RULES = 100
BUNDLE_MAX_PATTERN_CHARS = 500
BUNDLE_MAX_FUTURE_SECONDS = 600
BUNDLE_CACHE_TTL_SECONDS = 1800
BUNDLE_DEFAULT_CONFIDENCE = 0.9
BUNDLE_DEFAULT_MESSAGE = "配信ルールで検出された注意情報です。"
BUNDLE_REASON = {
    "format": "署名付きルールバンドルの形式が不正です",
    "alg": "未対応の署名方式です",
    "key_id": "署名鍵IDが一致しません",
    "no_key": "対応する公開鍵が見つかりません",
    "payload": "ルールバンドルの形式が不正です",
    "no_signature": "署名がありません",
    "signature": "ルールバンドルの署名を検証できません",
    "future": "ルールバンドルの生成日時が未来です",
    "expired": "ルールバンドルの有効期限が切れています",
    "paused": "ルール配信が停止されています",
    "check_failed": "ルールバンドルの署名検証に失敗しました",
    "http": "ルール配信APIから取得できませんでした",
    "fetch": "ルール配信APIの取得または検証に失敗しました",
}
