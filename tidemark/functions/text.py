"""Text expressions: clean-up, extraction, tokens, search predicates, chunks.

Search is AND over distinct tokens; a token is a maximal run of letters and
digits, lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters the search syntax reserves.
RESERVED_CHARACTERS = r"""\+-&|!(){}[]^"~*?:/'"""

_RESERVED_CLASS = "[" + "".join("\\" + ch for ch in RESERVED_CHARACTERS) + "]"


def escape_search(text: Column) -> Column:
    """Put a backslash before each reserved character."""
    return F.regexp_replace(text, f"({_RESERVED_CLASS})", r"\\$1")


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of a text."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def query_words(query: str) -> list[str]:
    """Distinct tokens of a query text, the same way ``tokens`` sees them."""
    spaced = "".join(ch if ch.isalnum() else " " for ch in query.lower())
    return list(dict.fromkeys(spaced.split()))


def has_all_words(text: Column, words: list[str]) -> Column:
    """True when every word is a token of the text; false without words.

    A plain substring test goes first, so most texts are never cut into tokens.
    """
    if not words:
        return F.lit(False)
    lowered = F.lower(F.coalesce(text, F.lit("")))
    result = F.lit(True)
    for word in words:
        result = result & F.contains(lowered, F.lit(word))
    found = tokens(text)
    wanted = F.array(*[F.lit(w) for w in words])
    return result & (F.size(F.array_except(wanted, found)) == 0)


def name_match_score(name: Column, query: str) -> Column:
    """3 for an equal name, 2 more for a common start, 1 more for all tokens."""
    return (
        F.when(name == query, 3).otherwise(0)
        + F.when(F.startswith(name, F.lit(query)), 2).otherwise(0)
        + F.when(has_all_words(name, query_words(query)), 1).otherwise(0)
    )


def news_match_score(title: Column, text: Column, words: list[str]) -> Column:
    return F.when(has_all_words(title, words), 2).otherwise(0) + F.when(
        has_all_words(text, words), 1
    ).otherwise(0)


def shorten(text: Column, length: int = 750) -> Column:
    """At most ``length`` characters, marked with ``...`` when cut; null becomes empty."""
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(""))
        .when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("...")))
        .otherwise(text)
    )


def clean_profile(text: Column) -> Column:
    """Drop line breaks, turn no-break spaces into spaces, trim, and shorten long runs."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, "\n", ""), "\u00a0", " "))
    return F.regexp_replace(F.regexp_replace(flat, " {4,}", "   "), "-{4,}", "---")


def chunk_key(url: Column, index: Column) -> Column:
    return F.concat(url, F.lit("#chunk"), index.cast("string"))


def chunk_id(url: Column, index: Column) -> Column:
    """Stable id of a chunk: md5 of its key."""
    return F.md5(chunk_key(url, index))


def marked_answer(text: Column) -> Column:
    """Number after ``####`` without thousands separators; null when there is none."""
    found = F.regexp_extract(text, r"#### (\-?[0-9\.\,]+)", 1)
    return F.nullif(F.regexp_replace(found, ",", ""), F.lit(""))


def entity_ticker(text: Column) -> Column:
    """Three-character ticker after the words for company, share or bank; null when absent."""
    found = F.regexp_extract(text, r"(?:công ty|cổ phiếu|ngân hàng)\s+([A-Z0-9]{3})\b", 1)
    return F.nullif(found, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def links(html: Column, pattern: str, base: str) -> Column:
    """Distinct link targets matching ``pattern`` (group 1), made absolute with ``base``."""
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    absolute = F.transform(
        found, lambda u: F.when(F.startswith(u, F.lit("http")), u).otherwise(F.concat(F.lit(base), u))
    )
    return F.array_distinct(absolute)


# -- HTML -----------------------------------------------------------------------

#: Stands where a tag or comment was taken out, so that text on both sides stays apart.
_GAP = "<!>"
# Named character references that articles use.
_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "middot": "·",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”",
}


def strip(text: Column) -> Column:
    """Without white space at both ends, no-break spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def visible(html: Column) -> Column:
    """Without scripts, styles and comments."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(</\1\s*>|\z)", _GAP)
    return F.regexp_replace(bare, r"(?s)<!--.*?(-->|\z)", _GAP)


def unescape(text: Column) -> Column:
    """Named references of the table above, and numbered ones, replaced; ``&amp`` comes last."""
    code = r"&#(?:x[0-9a-fA-F]{1,6}|[0-9]{1,7});"
    between = F.split(text, code, -1)
    numbers = F.transform(
        F.regexp_extract_all(text, F.lit(code), F.lit(0)),
        lambda c: F.when(F.startswith(c, F.lit("&#x")), F.conv(F.regexp_extract(c, "[0-9a-fA-F]+", 0), 16, 10))
        .otherwise(F.regexp_extract(c, "[0-9]+", 0)).cast("int"),
    )
    letters = F.transform(
        numbers, lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    )
    joined = F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(letters, i), F.lit("")))), "")
    out = F.when(F.contains(text, F.lit("&#")), joined).otherwise(text)
    for name, letter in _ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(letter))
    return F.when(F.contains(text, F.lit("&")), F.regexp_replace(out, "&amp;?", "&")).otherwise(text)


def plain_text(html: Column) -> Column:
    """Text of a fragment: the stripped pieces between tags, joined; empty for null."""
    pieces = F.split(F.coalesce(html, F.lit("")), r"<[^>]*>", -1)
    return F.array_join(F.transform(pieces, lambda p: strip(unescape(p))), "")


def _start_tag(tag: str, css_class: str | None) -> str:
    held = ""
    if css_class:
        held = rf"""(?=[^>]*\sclass\s*=\s*(?:["'](?:[^"'>]*\s)?{css_class}(?:\s[^"'>]*)?["']|{css_class}[\s>]))"""
    return rf"(?is)<{tag}\b{held}[^>]*>"


def _depths(tags: Column, begin: int) -> Column:
    """How many elements are open after each tag; ends without a start do not count."""
    start = F.struct(F.lit(begin).alias("d"), F.array().cast("array<int>").alias("all"))

    def step(state: Column, tag: Column) -> Column:
        now = F.when(F.startswith(tag, F.lit("</")), F.greatest(state["d"] - 1, F.lit(0))).otherwise(state["d"] + 1)
        return F.struct(now.alias("d"), F.concat(state["all"], F.array(now)).alias("all"))

    return F.aggregate(tags, start, step, lambda state: state["all"])


def after_start(html: Column, tag: str, css_class: str | None = None) -> Column:
    """What follows the start tag of the first matching element; null without one."""
    return F.get(F.split(html, _start_tag(tag, css_class), 2), F.lit(1))


def up_to_end(rest: Column, tag: str) -> Column:
    """What an element holds, given what follows its start tag; nested ones of its name included."""
    either = rf"(?is)</?{tag}\b[^>]*>"
    pieces = F.split(rest, either, -1)
    depths = _depths(F.regexp_extract_all(rest, F.lit(either), F.lit(0)), 1)
    end = F.array_position(depths, F.lit(0))
    inner = F.when(end > 0, F.slice(pieces, F.lit(1), end.cast("int"))).otherwise(pieces)
    return F.array_join(inner, _GAP)


def elements(html: Column, tag: str, css_class: str | None = None) -> Column:
    """Texts of all matching elements; one in another is part of both, empty ones stay."""
    html = F.coalesce(html, F.lit(""))
    either = rf"(?is)</?{tag}\b[^>]*>"
    tags = F.regexp_extract_all(html, F.lit(either), F.lit(0))
    texts = F.transform(F.split(html, either, -1), lambda p: plain_text(p))
    marked = F.struct(tags.alias("tags"), texts.alias("texts"), _depths(tags, 0).alias("depths"))
    # The arrays are made once a row, as an array of one.
    return F.flatten(F.transform(F.array(marked), lambda m: _spans(m, _start_tag(tag, css_class))))


def _spans(m: Column, start: str) -> Column:
    count = F.size(m["tags"])
    places = F.filter(F.sequence(F.lit(0), count), lambda i: F.coalesce(F.get(m["tags"], i), F.lit("")).rlike(start))

    def text(i: Column) -> Column:
        later = F.filter(F.sequence(i, count), lambda j: (j > i) & (F.get(m["depths"], j) < F.get(m["depths"], i)))
        end = F.coalesce(F.array_min(later), count)
        return F.array_join(F.slice(m["texts"], i + 2, end - i), "")

    return F.transform(places, text)


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` at the white space that follows."""
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def chunks(text: Column, size: int = 3076) -> Column:
    """Pack sentences greedily into chunks of about ``size`` characters.

    Each new chunk repeats the last sentence of the chunk before it. Every
    sentence is in a chunk, however long the text.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("open"),
        F.lit(None).cast("string").alias("last"),
        F.lit(0).alias("used"),
    )

    def step(state: Column, sentence: Column) -> Column:
        # Every sentence counts one separator, the first of a chunk included.
        spent = F.length(sentence) + 1
        full = state["open"].isNotNull() & (state["used"] + F.length(sentence) > size)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["open"])))
            .otherwise(state["done"])
            .alias("done"),
            F.when(full, F.concat_ws(" ", state["last"], sentence))
            .when(state["open"].isNull(), sentence)
            .otherwise(F.concat_ws(" ", state["open"], sentence))
            .alias("open"),
            sentence.alias("last"),
            F.when(full, F.length(state["last"]) + spent)
            .otherwise(state["used"] + spent)
            .alias("used"),
        )

    def finish(state: Column) -> Column:
        return F.concat(state["done"], F.array(state["open"]))

    return F.aggregate(sentences(text), start, step, finish)
