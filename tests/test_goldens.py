"""Whole texts written out, so that a wrong fixed value shows."""

from datetime import datetime

from quillcast.operators import compose, reports
from quillcast.plans.digest import digest_texts

ARTICLE = (
    "digest_id bigint, source_id bigint, position bigint, source_name string, title string, url string, "
    "summary string, url_hash string"
)
EVENING = datetime(2025, 5, 10, 1, 30)  # still the 9th in Toronto


def articles(spark):
    rows = [
        (1, 1, 0, "Lab (US)", "A *new* model!", "https://x.example/1", "It has 3 parts. It works. More later.", "h1"),
        (1, 2, 0, "Shop", "Markets", "https://x.example/2", "Funding of a startup", "h2"),
    ]
    return spark.createDataFrame(rows, ARTICLE)


def sources(spark):
    rows = [(1, 1, "Lab (US)", True), (2, 1, "Shop", True), (3, 1, "Off", False)]
    return spark.createDataFrame(rows, "source_id bigint, digest_id bigint, name string, active boolean")


def test_a_whole_digest(spark):
    words = {"🔬 Research": ["paper"], "🛠 Tools": ["model"], "💼 Business": ["funding"]}
    text = digest_texts(articles(spark), sources(spark), EVENING, topic_words=words).first().text
    assert text == (
        "📰 *Your Daily AI & Tech Digest*\n"
        "_Friday, May 9 2025, 2 articles from 2 sources_\n"
        "─────────────────────\n\n"
        "*🛠 Tools*\n\n"
        "*A \\*new\\* model\\!*\n"
        "It has 3 parts\\. It works\\. \\(Lab \\(US\\)\\)\n\n"
        "*💼 Business*\n\n"
        "*Markets*\n"
        "Funding of a startup \\(Shop\\)\n\n"
        "─────────────────────\n"
        "🤖 Summarised by Claude \\| /help for controls"
    )


def test_linked_headlines(spark):
    assert compose.linked_headlines(articles(spark), EVENING).first().text == (
        "📰 *Your Daily AI & Tech Digest*\n_Friday, May 9 2025_\n─────────────────────\n\n"
        "⚠️ *Summarisation unavailable — raw headlines:*\n\n"
        "• [A *new* model\\!](https://x.example/1) _\\(Lab \\(US\\)\\)_\n"
        "• [Markets](https://x.example/2) _\\(Shop\\)_\n\n"
        "─────────────────────\n🤖 /help for controls"
    )


def test_status_message(spark):
    ledger = spark.createDataFrame([("h", datetime(2025, 5, 9, 12))], "url_hash string, sent_at timestamp_ntz")
    report = reports.status_report(sources(spark), ledger, EVENING, "America/Toronto")
    assert reports.status_text(report).first().message == (
        "*📊 Bot Status*\n\nActive sources: 2\nArticles sent today: 1"
    )
