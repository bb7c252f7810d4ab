"""Text, search, HTML, transcript and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import periods
from tidemark.functions import text as tx
from tidemark.operators import documents, lookup, search, vector_store, vectors
from tidemark.operators.documents import ArticleLayout, Selector
from tidemark.plans.registry import query


def words(text: str) -> str:
    """SQL list of the distinct tokens of a text."""
    return (
        f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'),"
        " lambda w: w <> ''))"
    )


def has_all(text: str, query_words: list[str]) -> str:
    items = ", ".join(f"'{w}'" for w in query_words)
    return f"list_has_all({words(text)}, [{items}])"


STAMP = "strftime(pub_date, '%Y-%m-%d %H:%M:%S') AS pub_date"


def stamped(df):
    return df.withColumn("pub_date", F.date_format("pub_date", "yyyy-MM-dd HH:mm:ss"))


# -- expressions ------------------------------------------------------------------


@query(
    "scl4",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:00') AS iso FROM events WHERE event_id % 9 <> 0
    UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 9 = 0""",
)
def scl4(t):
    """Article times as printed on the page; unreadable ones become null."""
    printed = F.concat(F.date_format("ts", "dd-MM-yyyy - HH:mm"), F.lit(" PM"))
    text = F.when(F.col("event_id") % 9 == 0, F.date_format("ts", "yyyy/MM/dd")).otherwise(printed)
    iso = F.date_format(periods.article_time(text), "yyyy-MM-dd'T'HH:mm:ss")
    return t["events"].select("event_id", iso.alias("iso"))


@query("scl5", "SELECT url, CAST(epoch(pub_date) AS BIGINT) AS seconds FROM news", "news")
def scl5(t):
    """Publication times in epoch seconds."""
    return t.news.select("url", periods.epoch_seconds(F.col("pub_date")).alias("seconds"))


@query(
    "scl12",
    r"""SELECT doc_id, md5(regexp_replace(text, '([\\+\-&|!(){}\[\]^"~*?:/''])', '\\\1', 'g')) AS escaped FROM documents""",
)
def scl12(t):
    """Reserved search characters escaped, whole texts."""
    return t["documents"].select("doc_id", F.md5(tx.escape_search(F.col("text"))).alias("escaped"))


@query(
    "scl13",
    """SELECT doc_id, CASE WHEN length(text) > 750 THEN substring(text, 1, 750) || '...' ELSE text END AS short FROM documents""",
)
def scl13(t):
    """Texts shortened for display."""
    return t["documents"].select("doc_id", tx.shorten(F.col("text")).alias("short"))


@query(
    "scl15",
    f"""SELECT p_partkey, CASE WHEN p_name = 'red bolt' THEN 3 ELSE 0 END + CASE WHEN starts_with(p_name, 'red bolt') THEN 2 ELSE 0 END
        + CASE WHEN {has_all('p_name', ['red', 'bolt'])} THEN 1 ELSE 0 END AS score FROM part""",
)
def scl15(t):
    """Match score of names against a query."""
    return t["part"].select(
        "p_partkey", tx.name_match_score(F.col("p_name"), "red bolt").alias("score")
    )


@query("scl16", "SELECT url, md5(url || '#chunk' || chunk_index) AS id FROM points", "points")
def scl16(t):
    """Stable chunk ids."""
    return t.points.select("url", tx.chunk_id(F.col("url"), F.col("chunk_index")).alias("id"))


# -- search ----------------------------------------------------------------------------


def news_search(limit: int, with_text: bool, condition: str = "true") -> str:
    """SQL of a news search for the words "the" and "that"."""
    short = ", CASE WHEN length(text) > 750 THEN substring(text, 1, 750) || '...' ELSE text END AS text"
    return f"""SELECT url, title, source, {STAMP}, CAST(score AS INTEGER) AS score{short if with_text else ''} FROM (
      SELECT *, pub_date AS published, CASE WHEN {has_all('title', ['the', 'that'])} THEN 2 ELSE 0 END
        + CASE WHEN {has_all('text', ['the', 'that'])} THEN 1 ELSE 0 END AS score
      FROM news WHERE {has_all("title || ' ' || text", ['the', 'that'])} AND {condition}
        AND pub_date BETWEEN TIMESTAMP '2024-02-01' AND TIMESTAMP '2024-11-30')
    ORDER BY score DESC, published DESC, url LIMIT {limit}"""


@query(
    "txt1",
    news_search(20, True),
    "news",
)
def txt1(t):
    """Best articles holding all words, within a date range."""
    found = search.search_news(t.news, "The that", "2024-02-01", "2024-12-31", limit=20, as_of="2024-11-30")
    return stamped(found)


@query("txt1_channel", news_search(10, False, "channel_name = 'en'"), "news")
def txt1_channel(t):
    """The same within one channel."""
    return stamped(
        search.search_news(t.news, "that the", "2024-02-01", "2024-11-30", limit=10, channel="en")
    )


_DIM = "SELECT 'P' || p_partkey AS code, p_name AS name FROM part"


def dim(t):
    return t["part"].select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("name")
    )


@query(
    "txt2",
    f"SELECT code, name FROM dim WHERE {has_all("code || ' ' || name", ['ring', 'small'])}",
    extra={"dim": _DIM},
)
def txt2(t):
    """Codes whose code or name holds all words."""
    return lookup.search_names(dim(t), ["code", "name"], "Ring small")


@query(
    "txt3",
    f"""SELECT code, name, CAST(CASE WHEN name = 'red bolt' THEN 3 ELSE 0 END + CASE WHEN starts_with(name, 'red bolt') THEN 2 ELSE 0 END
        + CASE WHEN {has_all('name', ['red', 'bolt'])} THEN 1 ELSE 0 END AS INTEGER) AS score
    FROM dim ORDER BY score DESC, code LIMIT 10""",
    extra={"dim": _DIM},
)
def txt3(t):
    """Ten best names."""
    return lookup.best_names(dim(t), "code", "name", "red bolt")


@query("srt3", "SELECT code, score FROM (SELECT code, CAST(CASE WHEN name = 'blue gear' THEN 3 ELSE 0 END"
    " + CASE WHEN starts_with(name, 'blue gear') THEN 2 ELSE 0 END"
    f" + CASE WHEN {has_all('name', ['blue', 'gear'])} THEN 1 ELSE 0 END AS INTEGER) AS score FROM dim)"
    " ORDER BY score DESC, code LIMIT 10", extra={"dim": _DIM})
def srt3(t):
    """Ten codes by match score, filled up with score 0."""
    return lookup.best_names(dim(t), "code", "name", "blue gear").select("code", "score")


@query(
    "txt4",
    f"""SELECT url FROM news WHERE {has_all("title || ' ' || text", ['the', 'that', 'and'])}""",
    "news",
)
def txt4(t):
    """Articles holding all words, found through the stored token table."""
    from tidemark.sources.workspace import through_table

    tokens = search.sorted_tokens(search.token_table(t.news, "url", ["title", "text"]), "url")
    return search.search_tokens(through_table(tokens, "tokens"), "url", "the and that")


@query(
    "srt2",
    f"""SELECT url, {STAMP}, score FROM (
      SELECT url, pub_date, pub_date AS p, CAST(length(title) % 4 AS INTEGER) AS score FROM news)
    ORDER BY score DESC, p DESC, url LIMIT 25""",
    "news",
)
def srt2(t):
    """Top rows by score, newer first among equals."""
    rows = t.news.select("url", "pub_date", (F.length("title") % 4).alias("score"))
    return stamped(rows.orderBy(F.col("score").desc(), F.col("pub_date").desc(), "url").limit(25))


# -- chunks, pages, transcripts -----------------------------------------------------------


SENTENCES_SQL = r"""
    SELECT doc_id, 'doc://' || doc_id AS url,
      string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents"""

FOLD_SQL = """
    SELECT * FROM (WITH RECURSIVE f(doc_id, i, done, open, last, used) AS (
      SELECT doc_id, 1, CAST([] AS VARCHAR[]), s[1], s[1], length(s[1]) + 1 FROM sentences
      UNION ALL
      SELECT f.doc_id, f.i + 1,
        CASE WHEN f.used + length(s.s[f.i + 1]) > 3076 THEN list_append(f.done, f.open) ELSE f.done END,
        CASE WHEN f.used + length(s.s[f.i + 1]) > 3076 THEN f.last || ' ' || s.s[f.i + 1] ELSE f.open || ' ' || s.s[f.i + 1] END,
        s.s[f.i + 1],
        CASE WHEN f.used + length(s.s[f.i + 1]) > 3076 THEN length(f.last) + length(s.s[f.i + 1]) + 1
             ELSE f.used + length(s.s[f.i + 1]) + 1 END
      FROM f JOIN sentences s USING (doc_id) WHERE f.i < len(s.s))
    SELECT f.doc_id, list_append(f.done, f.open) AS every FROM f JOIN sentences s USING (doc_id) WHERE f.i = len(s.s))"""

CHUNKS_SQL = """
    SELECT doc_id, every AS parts FROM folded"""


@query(
    "txt5",
    "SELECT doc_id, CAST(len(parts) AS INTEGER) AS n, md5(array_to_string(parts, '|')) AS digest FROM chunked",
    "",
    {"sentences": SENTENCES_SQL, "folded": FOLD_SQL, "chunked": CHUNKS_SQL},
)
def txt5(t):
    """Texts cut into overlapping chunks of sentences."""
    rows = t["documents"].select("doc_id", tx.chunks(F.col("text")).alias("parts"))
    return rows.select(
        "doc_id", F.size("parts").alias("n"), F.md5(F.array_join("parts", "|")).alias("digest")
    )


@query(
    "txt6",
    r"""SELECT md5(url || '#chunk' || i) AS id, url, title, CAST(i AS INTEGER) AS chunk_index,
        CAST(len(parts) AS INTEGER) AS total_chunks, url || '#chunk' || i AS chunk_identifier,
        CAST(epoch(pub_date) AS BIGINT) AS pub_date, md5(parts[i + 1]) AS chunk
    FROM chunked JOIN (SELECT url, title, pub_date FROM news) n ON n.url = 'doc://' || doc_id
    JOIN (SELECT DISTINCT unnest(range(len(parts))) AS i FROM chunked) AS v ON i < len(parts)
    WHERE regexp_replace(parts[i + 1], '\s+', '', 'g') <> ''""",
    "news",
    {"sentences": SENTENCES_SQL, "folded": FOLD_SQL, "chunked": CHUNKS_SQL},
)
def txt6(t):
    """Chunk table with ids and positions."""
    return documents.chunk_table(t.news).withColumn("chunk", F.md5("chunk"))


PAGE_LAYOUT = ArticleLayout(title=Selector("h1"), content=Selector("article"))


_PLAIN = """trim(regexp_replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
    '&amp;?', '&', 'g'))"""
_TITLE = _PLAIN.format(x="regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")


@query(
    "txt7",
    f"""SELECT page_id, {_TITLE} AS title, CAST(NULL AS TIMESTAMP) AS pub_date,
        trim(array_to_string(list_transform(list_filter(range(len(tags)), lambda i: tags[i + 1] = '<p>'), lambda i: array_to_string(
          pieces[i + 2 : coalesce(list_min(list_filter(range(len(tags)), lambda j: j > i AND depths[j + 1] < depths[i + 1])), len(tags)) + 1],
          '')), chr(10)), chr(10) || ' ') AS text
    FROM (SELECT page_id, html, tags,
        list_transform(string_split_regex(content, '</?p>'), lambda p: array_to_string(
          list_transform(string_split_regex(p, '<[^>]*>'), lambda x: {_PLAIN.format(x='x')}), '')) AS pieces,
        list_transform(range(1, len(tags) + 1), lambda i: list_sum(list_transform(tags[1:i], lambda t: CASE t WHEN '<p>' THEN 1 ELSE -1 END))) AS depths
      FROM (SELECT *, regexp_extract_all(content, '</?p>') AS tags
        FROM (SELECT page_id, html, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS content FROM pages)))""",
)
def txt7(t):
    """Title and text of every page."""
    return documents.extract_articles(t["pages"], "page_id", layout=PAGE_LAYOUT)


@query("txt7_titles", f"SELECT page_id, {_TITLE} AS title FROM pages")
def txt7_titles(t):
    """Titles alone."""
    return documents.extract_articles(t["pages"], "page_id", layout=PAGE_LAYOUT).select("page_id", "title")


@query(
    "txt8",
    """SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(html, 'href="(/[^"]+)"', 1),
        lambda u: CASE WHEN starts_with(u, 'http') THEN u ELSE 'https://site.example' || u END))) AS link FROM pages""",
)
def txt8(t):
    """Distinct absolute links of every page."""
    return documents.page_links(t["pages"], "page_id", r'href="(/[^"]+)"', "https://site.example")


@query(
    "set4",
    """SELECT DISTINCT unnest(regexp_extract_all(html, 'href="(/[^"]+)"', 1)) AS link FROM pages""",
)
def set4(t):
    """Distinct links of all pages."""
    return documents.page_links(t["pages"], "page_id", r'href="(/[^"]+)"', "").select("link").distinct()


@query(
    "txt9",
    r"""SELECT conv_id, 0 AS part, regexp_replace(string_agg('## ' || upper(role[1]) || lower(role[2:]) || ':' || chr(10) || chr(10) || text || chr(10),
        chr(10) ORDER BY turn), '^\s+|\s+$', '', 'g') AS transcript FROM conversations GROUP BY conv_id""",
)
def txt9(t):
    """Conversations as one text."""
    return documents.transcripts(t["conversations"])


@query(
    "txt9_blocks",
    "SELECT conv_id, turn, '## ' || upper(role[1]) || lower(role[2:]) || ':' || chr(10) || chr(10) || text || chr(10) AS block FROM conversations",
)
def txt9_blocks(t):
    """Messages rendered one by one."""
    return documents.message_blocks(t["conversations"], "conv_id", "turn")


@query(
    "txt10",
    r"""SELECT conv_id, CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS BIGINT) AS words
    FROM conversations GROUP BY conv_id""",
)
def txt10(t):
    """Words per conversation."""
    return documents.transcript_words(t["conversations"])


# -- vectors ---------------------------------------------------------------------------------


_SCORES = """
    SELECT query_id, vec_id, url, list_dot_product(v, embedding)
        / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(embedding, embedding))) AS score
    FROM points, topics WHERE pub_date >= TIMESTAMP '2024-01-10' AND pub_date <= TIMESTAMP '2024-10-31'"""
_HITS = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scores)
    WHERE place <= 8"""
WINDOW = {"time": "pub_date", "start": "2024-01-10", "end": "2024-10-31"}


def rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query(
    "vec1",
    "SELECT query_id, vec_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM hits",
    "points topics",
    {"scores": _SCORES, "hits": _HITS},
)
def vec1(t):
    """Nearest chunks of each topic vector within a date range."""
    return rounded(vectors.nearest(t.points, t.topic_queries, k=8, **WINDOW))


@query(
    "vec1_store",
    "SELECT query_id, vec_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place, url FROM hits",
    "points topics",
    {"scores": _SCORES, "hits": _HITS},
)
def vec1_store(t):
    """The same from a store of parts with bounds."""
    store = vector_store.build_store(t.points, time="pub_date", payload=["url"], part_rows=64)
    asked = t.topic_queries.withColumnRenamed("embedding", "vector")
    return rounded(vector_store.search_store(store, asked, k=8, start=WINDOW["start"], end=WINDOW["end"])[0])


@query(
    "srt5",
    """SELECT vec_id, CAST(place AS INTEGER) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (
        SELECT query_id, vec_id, list_dot_product(v, embedding)
        / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(embedding, embedding))) AS score FROM points, topics WHERE query_id = 0))
        WHERE place <= 5""",
    "points topics",
)
def srt5(t):
    """Five nearest chunks of one vector."""
    return vectors.nearest(t.points, t.topic_queries.where("query_id = 0"), k=5).select("vec_id", "place")


_BEST = "SELECT query_id, url, max(score) AS score FROM hits GROUP BY ALL"


@query(
    "agg17",
    "SELECT query_id, url, round(score, 6) AS score FROM best",
    "points topics",
    {"scores": _SCORES, "hits": _HITS, "best": _BEST},
)
def agg17(t):
    """Best score per article."""
    hits = vectors.nearest(t.points, t.topic_queries, k=8, payload=["url"], **WINDOW)
    return rounded(vectors.best_per_url(hits))


_FIRST = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS place FROM best)
    WHERE place <= {n}"""


@query(
    "srt6",
    "SELECT query_id, url, CAST(place AS INTEGER) AS place FROM first WHERE url IN (SELECT url FROM news)",
    "points topics news",
    {"scores": _SCORES, "hits": _HITS, "best": _BEST, "first": _FIRST.format(n=3)},
)
def srt6(t):
    """First articles by score."""
    found = vectors.retrieve_articles(t.points, t.news, t.topic_queries, k=8, urls=3, **WINDOW)
    return found.select("query_id", "url", "place")


_ARTICLE = f"""SELECT query_id, url, round(score, 6) AS score, CAST(place AS INTEGER) AS place, title, source, {STAMP},
    CASE WHEN length(text) > 750 THEN substring(text, 1, 750) || '...' ELSE text END AS text
    FROM first JOIN news USING (url)"""


@query(
    "vec2",
    _ARTICLE,
    "points topics news",
    {"scores": _SCORES, "hits": _HITS, "best": _BEST, "first": _FIRST.format(n=10)},
)
def vec2(t):
    """Nearest chunks -> best articles -> full rows with short text."""
    found = vectors.retrieve_articles(t.points, t.news, t.topic_queries, k=8, **WINDOW)
    return stamped(rounded(found))


@query(
    "jn12",
    f"""SELECT url, title, source, {STAMP}, score,
        CASE WHEN length(text) > 750 THEN substring(text, 1, 750) || '...' ELSE text END AS text
    FROM news JOIN (SELECT url, CAST(count(*) AS DOUBLE) AS score FROM points GROUP BY url) USING (url)""",
    "points news",
)
def jn12(t):
    """Scored urls joined to their articles."""
    hits = t.points.groupBy("url").agg(F.count(F.lit(1)).cast("double").alias("score"))
    news = t.news.select("url", "title", "source", "pub_date", "text")
    return stamped(search.articles_for_hits(hits, news))


@query(
    "vec3",
    f"""SELECT 'vector' AS mode, url, title, round(score, 6) AS score FROM first JOIN news USING (url) WHERE query_id = 0
    UNION ALL SELECT * FROM (SELECT 'text', url, title, CAST(score AS DOUBLE) FROM (
      SELECT *, CASE WHEN {has_all('title', ['the', 'that'])} THEN 2 ELSE 0 END
        + CASE WHEN {has_all('text', ['the', 'that'])} THEN 1 ELSE 0 END AS score
      FROM news WHERE {has_all("title || ' ' || text", ['the', 'that'])}
        AND pub_date BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-10-31')
      ORDER BY score DESC, pub_date DESC, url LIMIT 8)""",
    "points topics news",
    {"scores": _SCORES, "hits": _HITS, "best": _BEST, "first": _FIRST.format(n=10)},
)
def vec3(t):
    """Both ways of retrieval, told apart by a mode column."""
    span = ("2024-01-10", "2024-10-31")
    by_vector = vectors.retrieve("vector", t.news, *span, limit=8, points=t.points, query=t.topic_queries.where("query_id = 0"))
    by_text = vectors.retrieve("text", t.news, *span, limit=8, query_text="the that")
    both = by_vector.withColumn("mode", F.lit("vector")).unionByName(
        by_text.withColumn("mode", F.lit("text"))
    )
    return rounded(both.select("mode", "url", "title", "score"))


@query(
    "vec4",
    f"""SELECT url, {STAMP} FROM (SELECT *, pub_date AS p FROM news WHERE text IS NOT NULL
        AND url NOT IN (SELECT url FROM points))""",
    "points news",
)
def vec4(t):
    """Oldest articles without vectors."""
    return stamped(documents.vectorize_queue(t.news, t.points).select("url", "pub_date"))


@query(
    "jn10",
    "SELECT url, source FROM news WHERE url NOT IN (SELECT url FROM points)",
    "points news",
)
def jn10(t):
    """Articles not processed yet."""
    return t.news.join(t.points.select("url"), "url", "left_anti").select("url", "source")
