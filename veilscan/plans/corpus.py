"""The texts the registered queries run over: all text columns, one row per text.

``memos`` are business notes spelled from the ``orders`` table, one per order.
The provided texts hold few of the shapes the rules look for (no phone numbers,
no amounts, no Japanese), so each order's own values are put into one of a set
of note forms. The expression is plain SQL and builds the same text in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import read_table


def _s(number: str) -> str:
    return f"CAST({number} AS STRING)"


def _pad(number: str, width: int, fill: str = "0") -> str:
    return f"LPAD({_s(number)}, {width}, '{fill}')"


_K, _C, _P = "o_orderkey", "o_custkey", "CAST(FLOOR(o_totalprice) AS BIGINT)"
_Y, _M, _D = "YEAR(o_orderdate)", "MONTH(o_orderdate)", "DAY(o_orderdate)"
_DAY = f"{_s(_Y)} || '年' || {_s(_M)} || '月' || {_s(_D)} || '日'"

# One note form per line group; a list is joined with line breaks.
_FORMS: list[list[str]] = [
    [
        "'担当: 佐藤一郎'",
        f"'連絡先は user' || {_s(_C)} || '@mail.example.com、電話番号は 090-' || {_pad(_K + ' % 10000', 4)} || '-' || "
        f"{_pad(_C + ' % 10000', 4)} || ' です。郵便番号は ' || {_pad(_C + ' % 1000', 3)} || '-' || "
        f"{_pad(_K + ' % 10000', 4)} || ' です。'",
    ],
    [
        "'A社向けの提案資料です。NDA締結前なので関係者限りで確認してください。'",
        f"'初期費用は' || {_s(_P)} || '円、月額' || {_s(_C + ' % 90 + 10')} || '万円です。'",
        f"'社内URL: https://staging.example.local/proposal/' || {_s(_K)}",
    ],
    [
        "'候補者の山田花子さんについて、最終面談後の評価メモです。'",
        f"'給与条件は現職より少し上げ、月額' || {_s(_C + ' % 90 + 10')} || '万円相当で検討します。'",
        f"{_DAY} || 'までに社内だけで確認してください。'",
    ],
    [
        f"'SECRET_TOKEN=AKIA' || {_pad(_K, 16)}",
        f"'deploy key AKIA' || {_pad(_C, 16)} || ' for build ' || {_s(_K)}",
    ],
    [
        f"'ghp_' || {_pad(_K, 24, 'a')} || ' xoxb-' || {_pad(_K, 12, 'b')}",
        f"'sk_test_' || {_pad(_K, 18, 'c')} || ' sk-' || {_pad(_K, 22, 'd')} || ' npm_' || {_pad(_K, 18, 'e')}",
    ],
    [
        f"'clientSecret: \"' || {_pad(_K, 20, 'z')} || '\"'",
        f"'通知先は https://hooks.slack.com/services/T' || {_s(_K)} || '/B' || {_s(_C)} || '/XXX です。'",
        f"'session ' || {_pad(_K, 10, 'a')} || '.' || {_pad(_C, 10, 'b')} || '.' || {_pad(_K, 10, 'c')}",
    ],
    [
        "'-----BEGIN PRIVATE KEY-----'",
        _pad(_K, 12, "m"),
        "'-----END PRIVATE KEY-----'",
        f"'接続先は postgres://app:pw' || {_s(_C)} || '@db.example.com/orders です。 https://user:pw' || {_s(_K)} || "
        "'@example.com/report'",
    ],
    [
        f"'個人番号は ' || {_pad(_K + ' % 10000', 4)} || '-' || {_pad(_C + ' % 10000', 4)} || '-' || "
        f"{_pad(_P + ' % 10000', 4)} || ' です。'",
        f"'注文番号は 1234-5678-9012 です。カード 4111 1111 1111 1111 と 4111 1111 1111 ' || {_pad(_K + ' % 10000', 4)}",
    ],
    [
        "'契約更新案です。NDAの条項と口外禁止の範囲を確認してください。'",
        f"'契約金額は' || {_s('CAST(FLOOR(o_totalprice / 10000) AS BIGINT)')} || '万円です。'",
        f"{_s(_Y)} || '/' || {_pad(_M, 2)} || '/' || {_pad(_D, 2)} || 'から有効。参照先: https://example.com/legal/' || {_s(_K)}",
    ],
    [
        f"'接続先は 10.' || {_s(_K + ' % 256')} || '.' || {_s(_C + ' % 256')} || '.7 と 203.0.113.' || "
        f"{_s(_K + ' % 300')} || ' です。'",
        f"'localhost:3000 と db' || {_s(_C)} || '.corp.example.com:5432/status を確認。'",
    ],
    [
        "'Project Blue Bridge の提案メモです。Phoenix案件の見積条件と新料金プラン移行PJの説明をまとめます。'",
        f"'株式会社サンプル' || {_s(_C + ' % 10')} || '向けの提案です。サンプル株式会社との契約更新です。'",
    ],
    [
        "'最終面談評価と年収条件を内定前に確認します。契約更新は発表前なので外には出さない予定です。"
        "社内だけで確認し、法務確認もお願いします。'",
    ],
    [f"'公開済みの製品紹介文です。番号' || {_s(_K)} || 'の案内は、どなたでも読めます。'"],
    ["'今日は天気がよい。'"],
    [
        f"'田中様と鈴木さんへ。¥' || {_s(_P)} || ' の請求条件、原価と粗利と予算の単価表を役員会前に共有。'",
        f"'￥1,234,567.50 と ' || {_s(_C)} || '円。期限は ' || {_s(_M)} || '月' || {_s(_D)} || '日。'",
    ],
    [
        f"'電話 03　1234　' || {_pad(_K + ' % 10000', 4)} || ' 月額　' || {_s(_P + ' % 1000')} || '円'",
        f"'個人番号 ' || {_pad(_K, 12)} || ' とお伝えください。高橋一郎です。'",
    ],
]


def _memo_sql() -> str:
    cases = "\n".join(
        f"WHEN {i} THEN {(' || ' + chr(39) + chr(10) + chr(39) + ' || ').join(lines)}" for i, lines in enumerate(_FORMS)
    )
    return f"CASE o_orderkey % {len(_FORMS)}\n{cases}\nEND"


MEMO_SQL = _memo_sql()


def _spell(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", "o_custkey", F.expr(MEMO_SQL).alias("text"))


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


def spread(texts: DataFrame) -> DataFrame:
    """Deal texts over the number of splits in the setting ``spark.veilscan.spread``; without it they stay as read.

    A small table may sit in one row group, and a scan is bound by the processor. For large inputs leave it unset.
    """
    splits = texts.sparkSession.conf.get("spark.veilscan.spread", None)
    return texts.repartition(int(splits)) if splits else texts


def dealt(rows: DataFrame) -> DataFrame:
    """Deal narrow rows over all cores before something costly is made of each.

    A million of them fit one row group, which one task would read and work through alone. Without the setting of
    :func:`spread` there are at least four parts per core.
    """
    spark = rows.sparkSession
    splits = spark.conf.get("spark.veilscan.spread", None)
    return rows.repartition(
        int(splits) if splits else max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    )


def memos(spark: SparkSession, folder: str) -> DataFrame:
    """One note per order."""
    return _spell(dealt(_orders(spark, folder)))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All texts as ``key`` and ``text``: documents, pages, chat turns and memos."""
    documents = read_table(spark, folder, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"), "text"
    )
    pages = read_table(spark, folder, "pages").select(
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("key"), F.col("html").alias("text")
    )
    turns = read_table(spark, folder, "conversations").select(
        F.concat_ws(":", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
        "text",
    )
    notes = memos(spark, folder).select(
        F.concat(F.lit("memo:"), F.col("o_orderkey").cast("string")).alias("key"), "text"
    )
    return spread(documents.unionByName(pages).unionByName(turns)).unionByName(notes)
