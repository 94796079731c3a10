"""Fixed values of the context layer: terms, thresholds, candidate texts."""

from __future__ import annotations

from typing import NamedTuple

from .patterns import SP

MIN_HINT_CHARS = 40
MIN_HINT_SCORE = 2
DEFAULT_WINDOW_CHARS = 360
MIN_WINDOW_PADDING = 40
MAX_INPUT_CHARS = 1200
MAX_CANDIDATES = 12
MAX_SURFACE_CHARS = 80
MIN_CANDIDATE_CONFIDENCE = 0.6
PRESELECT_CONFIDENCE = 0.75
WINDOW_SEPARATOR = "\n\n---\n\n"

# reason, score, terms
CONTEXT_TERMS = [
    ("near_confidential_hint", 3, [
        "nda", "confidential", "社外秘", "秘密", "取扱注意", "関係者限り", "未公開", "口外禁止", "正式発表前",
        "発表前", "外には出さない", "社外共有", "社内だけ", "社内限り", "法務", "法務確認",
    ]),
    ("near_business_context", 2, ["顧客", "提案", "見積", "契約", "契約更新", "役員会", "案件", "プロジェクト"]),
    ("near_money", 2, [
        "給与", "年収", "年収条件", "月額", "年額", "初期費用", "契約金額", "見積金額", "粗利", "原価", "予算",
        "単価", "請求条件", "万円", "円",
    ]),
    ("near_person_like", 2, [
        "採用", "候補者", "面談", "最終面談評価", "評価メモ", "退職理由", "内定", "内定前",
    ]),
]
# Most Han characters are known by their range, without a look at their script, and other characters are told apart first.
_NO_HAN = "\\u0000-\\u2E7F\\u3040-\\u30F4"
HONORIFIC_NAME = (
    f"(?=[^{_NO_HAN}])[\\u4E00-\\u9FEF[[^{_NO_HAN}]&&[々〆ヵヶ\\p{{IsHan}}]]]{{1,6}}(?:様|さん|氏|先生|くん|ちゃん)"
)
# Digits right after others share their end, so only the first of a run is tried.
MONEY_LIKE = f"(?=[¥0-9])(?:¥{SP}?[0-9][0-9,]*+|(?<![0-9])(?<![0-9],)[0-9][0-9,]*+(?:円|万円))"


# --- residual terms --------------------------------------------------------


class Residual(NamedTuple):
    category: str
    prefix: str
    label: str
    reason: str
    confidence: float


PERSON = Residual(
    "person_name", "PERSON", "人名候補",
    "敬称つきの個人名らしい表現です。外部に送る前に確認したい候補です。", 0.86,
)
CUSTOMER = Residual(
    "customer_name", "CUSTOMER", "顧客名・会社名候補",
    "提案先や顧客名らしい表現です。外部に送る前に確認したい候補です。", 0.8,
)
COMPANY = Residual(
    "company_name", "COMPANY", "会社名候補",
    "法人格や組織種別つきの会社名らしい表現です。外部に送る前に確認したい候補です。", 0.82,
)
PROJECT = Residual(
    "project_name", "PROJECT", "案件名・プロジェクト名候補",
    "Project形式の案件名らしい表現です。外部に送る前に確認したい候補です。", 0.82,
)
BUSINESS_TERMS = [
    (Residual("contract_info", "CONTRACT_INFO", "契約情報候補",
              "契約や見積条件に関する文脈です。外部に送る前に確認したい候補です。", 0.78),
     ["契約更新", "NDA締結前", "見積条件", "年間契約"]),
    (Residual("hr_info", "HR_INFO", "採用・人事情報候補",
              "採用や人事評価に関する文脈です。外部に送る前に確認したい候補です。", 0.8),
     ["最終面談評価", "最終面談後の評価メモ", "評価メモ", "年収条件", "給与条件", "退職理由", "内定前"]),
    (Residual("legal_info", "LEGAL_INFO", "法務情報候補",
              "法務確認や契約書レビューに関する文脈です。外部に送る前に確認したい候補です。", 0.78),
     ["法務確認", "契約書レビュー", "利用規約改定", "弁護士確認"]),
    (Residual("financial_info", "FINANCIAL_INFO", "金融・条件情報候補",
              "金額条件や社内の数値条件に関する文脈です。外部に送る前に確認したい候補です。", 0.76),
     ["粗利", "原価", "予算", "単価", "請求条件"]),
    (Residual("internal_info", "INTERNAL_INFO", "社内情報候補",
              "社内だけで扱う前提の文脈です。外部に送る前に確認したい候補です。", 0.78),
     ["社内だけで確認", "社内限り", "役員会前"]),
    (Residual("confidential_context", "CONFIDENTIAL_CONTEXT", "未公開・社外秘文脈候補",
              "未公開または外部共有を避ける文脈です。外部に送る前に確認したい候補です。", 0.8),
     ["発表前なので外には出さない", "正式発表前", "外には出さない", "社外共有はしない"]),
]
BUSINESS_CATEGORIES = [
    "contract_info", "hr_info", "legal_info", "financial_info", "internal_info", "confidential_context",
]
CORPORATE_PREFIXES = "株式会社|有限会社|合同会社|学校法人|医療法人|社会福祉法人|一般社団法人|一般財団法人"
CORPORATE_SUFFIXES = "株式会社|有限会社|合同会社|銀行|病院|大学|研究所"
PERSON_LABEL_WORDS = "担当|参加者|レビュー|作成者|相談者|依頼者|候補者|面談者|申請者"
PROJECT_SUFFIXES = "計画|案件|PJ|プロジェクト"

# --- candidates ------------------------------------------------------------

CANDIDATE_PREFIX = {
    "person_name": "PERSON", "company_name": "COMPANY", "customer_name": "CUSTOMER",
    "location_name": "LOCATION", "facility_name": "FACILITY", "product_name": "PRODUCT",
    "event_name": "EVENT", "project_name": "PROJECT", "contract_info": "CONTRACT_INFO",
    "hr_info": "HR_INFO", "legal_info": "LEGAL_INFO", "financial_info": "FINANCIAL_INFO",
    "internal_info": "INTERNAL_INFO", "confidential_context": "CONFIDENTIAL_CONTEXT", "other": "CONTEXT",
}
GENERIC_NOUNS = [
    "提案", "資料", "会議", "契約", "見積", "採用", "給与", "法務", "社内", "社外", "確認", "共有", "候補", "プロジェクト",
]
GENERIC_NOUN_CATEGORIES = ["company_name", "customer_name", "project_name"]
FOUND_MESSAGE = "AI文脈チェックで注意候補が見つかりました。"
NONE_MESSAGE = (
    "AI文脈チェックでは追加の注意候補は見つかりませんでした。ただし、安全を保証するものではありません。"
)

# --- entity tokens ---------------------------------------------------------

MIN_TOKEN_SCORE = 0.72
ENTITY_REASON_TAIL = " ブラウザ内の固有表現抽出モデルによる補助候補です。"
_ORG_REASON = "組織名として抽出された表現です。外部に送る前に確認したい候補です。"
# token label -> category, label, reason, prefix, risk level
ENTITY_TYPES = {
    "PER": ("person_name", "人名候補",
            "人名として抽出された表現です。外部に送る前に確認したい候補です。", "PERSON", "medium"),
    "ORG": ("company_name", "組織名・会社名候補",
            "組織名または会社名として抽出された表現です。外部に送る前に確認したい候補です。", "COMPANY", "medium"),
    "ORG-P": ("company_name", "組織名候補", _ORG_REASON, "COMPANY", "medium"),
    "ORG-O": ("company_name", "組織名候補", _ORG_REASON, "COMPANY", "medium"),
    "LOC": ("location_name", "地名・住所候補",
            "地名または住所の一部として抽出された表現です。外部に送る前に確認したい候補です。", "LOCATION", "medium"),
    "INS": ("facility_name", "施設名候補",
            "施設名として抽出された表現です。外部に送る前に確認したい候補です。", "FACILITY", "medium"),
    "PRD": ("product_name", "製品名候補",
            "製品名として抽出された表現です。公開前の名称でないか確認したい候補です。", "PRODUCT", "low"),
    "EVT": ("event_name", "イベント名候補",
            "イベント名として抽出された表現です。公開前の名称でないか確認したい候補です。", "EVENT", "low"),
}

# --- business-context prototypes -------------------------------------------

MAX_SEGMENTS = 8
MAX_SEGMENT_CHARS = 240
MIN_SEGMENT_CHARS = 6
MIN_SIMILARITY = 0.82
MIN_SIMILARITY_MARGIN = 0.015
TOPIC_PREFIX = "トピック: "
SEMANTIC_REASON_TAIL = " ブラウザ内の小型日本語モデルによる補助候補です。"
# category, label, reason, prefix, prototype text
PROTOTYPES = [
    ("contract_info", "契約情報候補", "契約、見積、NDA、更新条件などの取引情報に近い文脈です。", "CONTRACT_INFO",
     "契約条件、見積、NDA、契約更新など外部共有前に確認したい取引情報"),
    ("hr_info", "採用・人事情報候補", "候補者評価、採用判断、給与、退職などの人事情報に近い文脈です。", "HR_INFO",
     "候補者の面談評価、採用判断、給与条件、退職理由、人事評価などの人事情報"),
    ("legal_info", "法務情報候補", "契約書、紛争、法務相談などの法務情報に近い文脈です。", "LEGAL_INFO",
     "契約書レビュー、訴訟、紛争、弁護士相談、法的見解などの法務情報"),
    ("financial_info", "金融・条件情報候補", "予算、原価、粗利、請求条件などの社内数値に近い文脈です。", "FINANCIAL_INFO",
     "予算、原価、粗利、単価、請求条件、売上見込みなどの非公開財務情報"),
    ("internal_info", "社内情報候補", "社内だけで扱う業務情報に近い文脈です。", "INTERNAL_INFO",
     "社内会議、役員会、内部方針、社内限定など組織内だけで扱う業務情報"),
    ("confidential_context", "未公開・社外秘文脈候補", "正式発表前、外部共有禁止などの未公開情報に近い文脈です。",
     "CONFIDENTIAL_CONTEXT",
     "正式発表前、未公開、口外禁止、社外共有禁止など外部へ出せない秘密情報"),
]

# --- partial failure -------------------------------------------------------

ENTITY_STAGE_WARNING = "固有表現抽出を実行できませんでした。"
SEMANTIC_STAGE_WARNING = "文脈分類を実行できませんでした。"
ANALYSIS_FAILED = (
    "ブラウザ内のAI文脈チェックを実行できませんでした。ルールベースの検出結果は引き続き利用できます。"
)
PARTIAL_SUMMARY = (
    "一部のモデルは利用できませんでしたが、ブラウザ内のAI文脈チェックで注意候補を確認しました。"
)
FOUND_SUMMARY = "ブラウザ内のAI文脈チェックで注意候補が見つかりました。"
NONE_SUMMARY = (
    "ブラウザ内のAI文脈チェックでは追加の注意候補は見つかりませんでした。安全を保証するものではありません。"
)
