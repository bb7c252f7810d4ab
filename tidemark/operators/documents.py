"""News chunks, article extraction from HTML, transcripts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import periods
from tidemark.functions import text as tx


def chunk_table(news: DataFrame, size: int = 3076) -> DataFrame:
    """One row per non-blank chunk of every non-blank text, with id and position."""
    filled = news.where(tx.strip(F.coalesce("text", F.lit(""))) != "")
    parts = filled.withColumn("parts", tx.chunks(F.col("text"), size))
    rows = parts.select(
        "url",
        "title",
        "pub_date",
        F.size("parts").alias("total_chunks"),
        F.posexplode("parts").alias("chunk_index", "chunk"),
    ).where(tx.strip(F.col("chunk")) != "")
    return rows.select(
        tx.chunk_id(F.col("url"), F.col("chunk_index")).alias("id"),
        "url",
        "title",
        "chunk_index",
        "total_chunks",
        tx.chunk_key(F.col("url"), F.col("chunk_index")).alias("chunk_identifier"),
        periods.epoch_seconds(F.col("pub_date")).alias("pub_date"),
        "chunk",
    )


def vectorize_queue(
    news: DataFrame, done: DataFrame, limit: int | None = None, key: str = "url", time: str = "pub_date"
) -> DataFrame:
    """Articles with text that are not in ``done`` yet; the ``limit`` oldest if one is given."""
    waiting = news.where(F.col("text").isNotNull()).join(done.select(key), key, "left_anti")
    return waiting if limit is None else waiting.orderBy(time, key).limit(limit)


# -- HTML ---------------------------------------------------------------------


@dataclass(frozen=True)
class Selector:
    """A tag name and, if set, a class it must carry."""

    tag: str
    css_class: str | None = None


@dataclass(frozen=True)
class ArticleLayout:
    """Where a site keeps title, date and paragraphs."""

    title: Selector = Selector("h1", "title")
    date_box: Selector = Selector("div", "sharemxh")
    date: Selector = Selector("span", "pdate")
    content: Selector = Selector("div", "contentdetail")
    paragraph: Selector = Selector("p")


def extract_articles(
    pages: DataFrame, key: str, html: str = "html", layout: ArticleLayout = ArticleLayout()
) -> DataFrame:
    """Title, publication time and text of each page.

    An element reaches to its end tag, counting nested ones of its name, or to the end of what
    holds it; so an unclosed paragraph holds the ones after it. Everything is built-in
    expressions. Without the element the text is empty and the time null.
    """
    # One step a projection: what is used twice is then made once.
    page = pages.select(key, tx.visible(F.coalesce(F.col(html), F.lit(""))).alias("__page"))
    boxes = {"__title": layout.title, "__box": layout.date_box, "__content": layout.content}
    found = page.select(key, *[tx.after_start(F.col("__page"), s.tag, s.css_class).alias(n) for n, s in boxes.items()])
    found = found.select(key, *[tx.up_to_end(F.col(n), s.tag).alias(n) for n, s in boxes.items()])
    found = found.select(
        key,
        tx.plain_text(F.col("__title")).alias("title"),
        tx.after_start(F.col("__box"), layout.date.tag, layout.date.css_class).alias("__date"),
        tx.elements(F.col("__content"), layout.paragraph.tag, layout.paragraph.css_class).alias("__paragraphs"),
    )
    date = tx.plain_text(tx.up_to_end(F.col("__date"), layout.date.tag))
    paragraphs = F.col("__paragraphs")
    return found.select(
        key,
        "title",
        periods.article_time(date).alias("pub_date"),
        tx.strip(F.array_join(paragraphs, "\n")).alias("text"),
    )


def page_links(pages: DataFrame, key: str, pattern: str, base: str, html: str = "html") -> DataFrame:
    """One row per page and distinct absolute link."""
    return pages.select(key, F.explode(tx.links(F.col(html), pattern, base)).alias("link"))


# -- transcripts ----------------------------------------------------------------


def message_blocks(messages: DataFrame, conversation: str, turn: str) -> DataFrame:
    """Each message rendered on its own: header, text, tool calls, response id.

    ``tool_calls`` (array of struct(id, name, arguments)) and ``tool_call_id``
    are optional columns.
    """
    role = F.concat(F.upper(F.substring("role", 1, 1)), F.lower(F.substring("role", 2, 1 << 30)))
    header = F.coalesce(role, F.lit("Unknown"))
    parts = [
        F.when(
            F.col("text").isNotNull(), F.concat(F.lit("## "), header, F.lit(":\n\n"), "text", F.lit("\n"))
        )
    ]
    if "tool_calls" in messages.columns:
        has_calls = F.coalesce(F.size("tool_calls"), F.lit(0)) > 0
        lines = F.transform(
            "tool_calls",
            lambda c: F.concat(
                F.lit("- **"),
                F.coalesce(c["name"], F.lit("unknown")),
                F.lit("** (ID: "),
                F.coalesce(c["id"], F.lit("unknown")),
                F.lit(")\n Arguments: "),
                F.coalesce(c["arguments"], F.lit("{}")),
                F.lit("\n"),
            ),
        )
        no_text = F.coalesce(F.col("text"), F.lit("")) == ""
        parts += [
            F.when(has_calls & no_text, F.concat(F.lit("## "), header, F.lit(":\n"))),
            F.when(has_calls, F.lit("### Tool Calls:\n")),
            F.when(has_calls, F.array_join(lines, "\n")),
            F.when(has_calls, F.lit("\n")),
        ]
    block = F.concat_ws("\n", *parts)
    if "tool_call_id" in messages.columns:
        answer = F.concat(
            F.regexp_replace(block, r"\s+$", ""),
            F.lit(" (Response to: "),
            F.col("tool_call_id"),
            F.lit(")\n\n"),
        )
        block = F.when(F.coalesce("tool_call_id", F.lit("")) != "", answer).otherwise(block)
    return messages.select(conversation, turn, block.alias("block"))


def transcripts(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", part_turns: int = 10_000
) -> DataFrame:
    """Text of each conversation, messages in turn order, in parts of ``part_turns`` turns.

    An ordinary conversation is one part (0). The parts of a longer one follow
    each other, so no conversation has to fit in one row.
    """
    blocks = message_blocks(messages, conversation, turn)
    ordered = F.array_sort(F.collect_list(F.struct(turn, "block")))
    joined = F.array_join(F.transform(ordered, lambda m: m["block"]), "\n")
    text = F.regexp_replace(joined, r"^\s+|\s+$", "")
    part = F.floor(F.col(turn) / part_turns).cast("int").alias("part")
    return blocks.groupBy(conversation, part).agg(text.alias("transcript"))


def transcript_words(messages: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Words per conversation."""
    return messages.groupBy(conversation).agg(
        F.sum(F.coalesce(tx.word_count(F.col("text")), F.lit(0))).alias("words")
    )
