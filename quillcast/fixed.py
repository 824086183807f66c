"""Limits, word lists and texts the results depend on."""

# Limits.
FEED_CAP = 10               # raw entries, or page links, taken per source
DIGEST_CAP = 30             # new articles shown in one digest
LISTING_CAP = 20            # repository paths taken per listing page
REPORT_SIZE = 10            # repositories in a trending report
SUMMARY_CHARS = 500
REPO_TEXT_CHARS = 80
MESSAGE_CHARS = 4096
SEEN_TTL = "30 days"
DIGEST_TIME = "08:00"
DIGEST_ZONE = "America/Toronto"

# Digest topics, in display order; the last one is the default.
TOPICS = [
    "🔬 AI Research",
    "🛠 Tools & Models",
    "🏢 Industry & Business",
    "📊 Data & MLOps",
    "🌐 Tech News",
]

# Words that place an article under a topic (a parameter of ``topic_assign``).
TOPIC_WORDS = {
    TOPICS[0]: ["research", "paper", "benchmark", "study", "theorem", "dataset", "arxiv"],
    TOPICS[1]: ["model", "models", "tool", "tools", "release", "api", "sdk", "library"],
    TOPICS[2]: ["business", "funding", "acquisition", "market", "startup", "revenue"],
    TOPICS[3]: ["data", "pipeline", "mlops", "warehouse", "spark", "training", "deployment"],
    TOPICS[4]: ["technology", "software", "hardware", "internet"],
}

# Words that make a repository relevant to the trending report.
TREND_WORDS = [
    "ai", "llm", "gpt", "claude", "agent", "ml", "model", "neural",
    "transformer", "inference", "embedding", "rag", "diffusion", "vision",
    "nlp", "openai", "anthropic", "gemini", "copilot", "code", "automation",
    "workflow", "prompt",
]

# Topics a repository needs for the fallback report.
FALLBACK_TOPICS = ["llm", "ai-agents"]

# Sources of a new registry (name, url, type).
DEFAULT_SOURCES = [
    ("Google AI Blog", "https://blog.google/technology/ai/rss/", "rss"),
    ("OpenAI Blog", "https://openai.com/blog/rss.xml", "rss"),
    ("Anthropic Blog", "https://www.anthropic.com/rss.xml", "rss"),
    ("HuggingFace Blog", "https://huggingface.co/blog/feed.xml", "rss"),
    ("TLDR AI", "https://tldr.tech/api/rss/ai", "rss"),
    ("Hacker News AI", "https://hnrss.org/newest?q=AI+LLM+machine+learning&count=20", "rss"),
    ("MIT Technology Review", "https://www.technologyreview.com/feed/", "rss"),
    ("The Batch (DeepLearning.AI)", "https://www.deeplearning.ai/the-batch/feed/", "rss"),
]

# Texts of digests, reports and outcomes.
NO_TITLE = "No title"
NO_LANGUAGE = "N/A"
NO_DESCRIPTION = "No description"
UNTITLED = "Untitled"
SEPARATOR = "─" * 21
DIGEST_TITLE = "📰 *Your Daily AI & Tech Digest*"
DIGEST_FOOTER = "🤖 Summarised by Claude \\| /help for controls"
PLAIN_FOOTER = "🤖 /help for controls"
HEADLINES_INTRO = "⚠️ Summarisation failed, here are raw headlines:"
LINKED_INTRO = "⚠️ *Summarisation unavailable — raw headlines:*"
TRENDING_TITLE = "⭐ *Trending AI/ML GitHub Repos* — this week"
FIGURES = "%d articles from %d sources"
SOURCE_LINE = "%s #%d %s [%s]"
STATUS = "*📊 Bot Status*\n\nActive sources: %d\nArticles sent today: %d"
NOTHING_FETCHED = "✅ No articles fetched from any source."
NOTHING_NEW = "✅ No new articles since last digest."
NO_REPOS = "❌ No trending repos found."
