"""The record types that move between stages, as Spark DDL."""

from __future__ import annotations

ARTICLES = "id string, source_url string, title string, raw_html string, text_content string, language string, published_date timestamp_ntz, created_at timestamp"
PROCESSED = (
    "id string, article_id string, translated_text string, translated_title string, source_language string, target_language string, "
    "embedding array<float>, tags array<string>, entities array<string>, tag_categories map<string,array<string>>, cluster_id string, "
    "summary string, processing_status string, created_at timestamp, updated_at timestamp"
)
CLUSTERS = (
    "id string, created_at timestamp, updated_at timestamp, label string, description string, center_embedding array<float>, member_count int, "
    "top_tags array<string>, top_entities array<string>, summary string, representative_article_id string, status string"
)
SCRAPED = "title string, content string, author string, date string, source_name string, url string, type string, language string, needs_translation boolean, raw_html string"
SOURCES = "name string, url string, type string"
INGEST = "id string, title string, body string, region string, topic string, source_url string"
CLUSTERING_QUEUE = "article_id string, title string, raw_text string, cleaned_text string, embedding array<float>, region string, topic string, source_url string"
TAGGING_QUEUE = "article_id string, translated_content string, translated_title string, original_language string"
EMBEDDING_QUEUE = "article_id string, content string, title string, tags array<string>, entities array<string>"
STATUS_EVENT = "pipeline_id string, stage string, message string, timestamp string"

#: Names under which a field may arrive; the first one that is present and not null counts.
ALIASES = {
    "id": ("id", "article_id"),
    "title": ("title", "title_translated", "title_original"),
    "content": ("content", "cleaned_text", "body", "text_content", "summary"),
    "url": ("url", "source_url", "link"),
    "published_date": ("published_date", "date", "published_at"),
}
