"""Curation of pages and documents, and transcripts of conversations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillon.functions.text import hash_bucket, strip
from quillon.operators import curation as C
from quillon.operators import maintenance as M
from quillon.plans.maintenance import FINGER
from quillon.plans.registry import query
from quillon.staging import stage

STRONG, EXTRA = ("the", "des", "und", "los"), ("er", "in")
TOPICS, NOISE = ("th", "en", "de"), "[#$%&*]{3}"
SITES = ("[^|]*heha", "[^|]*ing")


def _unescape_sql(x: str) -> str:
    for entity, character in C.ENTITIES:
        c = character.replace("'", "''")
        x = f"replace({x}, '{entity}', '{c}')"
    return x


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _norm_sql(x: str) -> str:
    x = _unescape_sql(f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')")
    x = f"regexp_replace({x}, '[ \\t\u3000\u00a0]+', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip_sql(x)


def _tags_sql(x: str) -> str:
    for tag in ("script", "style", "noscript"):
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?i)</(p|div|li|h[1-6]|tr|table|section|article)>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?i)<li[^>]*>', chr(10) || '· ', 'g')"
    return _norm_sql(f"regexp_replace({x}, '<[^>]+>', '', 'g')")


TITLE = _strip_sql(_unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
BODY = _tags_sql("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")


@query(f"SELECT page_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT page_id, {_tags_sql('html')} AS t FROM pages)")
def strip_tags(spark, table):
    text = C.strip_tags(F.col("html"))
    return table("pages").select("page_id", F.md5(text).alias("digest"), F.length(text).cast("long").alias("n_chars"))


@query(f"SELECT page_id, {TITLE} AS title FROM pages")
def html_title(spark, table):
    return table("pages").select("page_id", C.html_title(F.col("html")).alias("title"))


def _clean_sql(x: str) -> str:
    x = _tags_sql(x)
    for _ in range(3):
        x = f"regexp_replace({x}, '\\s*[_|｜]\\s*({'|'.join(SITES)})\\s*$', '')"
    return f"regexp_replace({x}, '^[ _|｜]+|[ _|｜]+$', '', 'g')"


@query("SELECT page_id, " + _clean_sql(f"{TITLE} || ' | ' || url || ' | heha_ing'") + " AS title FROM pages")
def clean_title(spark, table):
    raw = F.concat(C.html_title(F.col("html")), F.lit(" | "), F.col("url"), F.lit(" | heha_ing"))
    return table("pages").select("page_id", C.clean_title(raw, SITES).alias("title"))


@query(f"SELECT page_id, md5(b) AS digest, length(b) AS n_chars FROM (SELECT page_id, CASE WHEN length(b) >= 200 THEN b ELSE '' END AS b FROM (SELECT page_id, {BODY} AS b FROM pages))")
def html_body_extract(spark, table):
    body = C.html_body(F.col("html"))
    return table("pages").select("page_id", F.md5(body).alias("digest"), F.length(body).cast("long").alias("n_chars"))


#: Pages in a container whose own blocks have its tag, pages with their own, and pages without one, which are taken whole.
NESTED = """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<DIV class="a TRS_Editor b"><div>' || html || '</div><div><div>end</div></div>'
  WHEN 1 THEN regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) ELSE replace(replace(html, '<article', '<section'), '</article', '</section') END AS part FROM pages"""


@query(f"SELECT page_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT page_id, {_tags_sql('part')} AS t FROM ({NESTED}))")
def html_nested(spark, table):
    """Containers with nested blocks of their own tag; pages without one are taken whole."""
    html, third = F.col("html"), F.col("page_id") % 3
    wrapped = F.concat(F.lit('<div class="ad">x</div><DIV class="a TRS_Editor b"><div>'), html, F.lit('</div><div><div>end</div></div></DIV><div id="zoom">after</div>'))
    page = F.when(third == 0, wrapped).when(third == 1, html).otherwise(F.replace(F.replace(html, F.lit("<article"), F.lit("<section")), F.lit("</article"), F.lit("</section")))
    body = C.html_body(F.col("page"), least=1, require_container=False)
    return table("pages").select("page_id", page.alias("page")).select("page_id", body.alias("t")).select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n_chars"))


@query(f"SELECT page_id, md5({_norm_sql('html')}) AS digest FROM pages")
def norm_text(spark, table):
    return table("pages").select("page_id", F.md5(C.norm_text(F.col("html"))).alias("digest"))


@query(
    """SELECT page_id, array_to_string(list_distinct_in_order, ' ') AS links, len(list_distinct_in_order) AS n_links FROM (
SELECT page_id, list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]) AS list_distinct_in_order FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"#]+)', 1) AS l FROM pages))"""
)
def extract_links(spark, table):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), F.lit(1)))
    return table("pages").select("page_id", F.array_join(links, " ").alias("links"), F.size(links).cast("long").alias("n_links"))


@query("SELECT page_id, url FROM pages WHERE (starts_with(url, 'https://') AND ends_with(url, '.html')) OR regexp_matches(url, '/[0-9]{3,}')")
def url_filter(spark, table):
    url = F.col("url")
    return table("pages").where((url.startswith("https://") & url.endswith(".html")) | url.rlike("/[0-9]{3,}")).select("page_id", "url")


@query(
    f"""SELECT page_id, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace({TITLE}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), '_+$', ''), ''), 'doc') AS slug FROM pages"""
)
def slug(spark, table):
    return table("pages").select("page_id", C.slug(C.html_title(F.col("html"))).alias("slug"))


def _score_sql(title: str, head: str) -> str:
    parts = [f"CASE WHEN contains({title}, '{w}') THEN 3 ELSE 0 END + CASE WHEN contains({head}, '{w}') THEN 1 ELSE 0 END" for w in STRONG]
    parts += [f"CASE WHEN contains({title}, '{w}') THEN 2 WHEN contains({head}, '{w}') THEN 1 ELSE 0 END" for w in EXTRA]
    return " + ".join(parts)


PAGES = f"p AS (SELECT page_id, {TITLE} AS title, {BODY} AS body0 FROM pages), q AS (SELECT page_id, title, CASE WHEN length(body0) >= 200 THEN body0 ELSE '' END AS body FROM p), r AS (SELECT *, {_score_sql('title', 'substr(body, 1, 1500)')} AS score FROM q)"
GATE = f"""CASE WHEN coalesce(title, '') = '' THEN 'empty title' WHEN regexp_extract(title, '({NOISE})', 1) <> '' THEN 'noise: ' || regexp_extract(title, '({NOISE})', 1)
WHEN NOT regexp_matches(title, '{'|'.join(TOPICS)}') THEN 'off topic' WHEN length(body) < 400 THEN 'short body' WHEN score < 4 THEN 'score ' || CAST(score AS VARCHAR) END"""


def pages_of(table):
    """Titles and texts are written once: filters on them would else repeat the cleaning."""
    pages = stage(table("pages").select("page_id", C.html_title(F.col("html")).alias("title"), C.html_body(F.col("html")).alias("body")), "pages")
    pages = pages.withColumn("score", C.relevance(F.col("title"), F.col("body"), STRONG, EXTRA))
    return pages.withColumn("reason", C.gate(F.col("title"), F.col("body"), NOISE, TOPICS, F.col("score")))


@query(f"WITH {PAGES} SELECT page_id, CAST(score AS BIGINT) AS score FROM r")
def relevance_score(spark, table):
    return pages_of(table).select("page_id", F.col("score").cast("long").alias("score"))


@query(f"WITH {PAGES} SELECT page_id, {GATE} AS reason FROM r")
def relevance_gate(spark, table):
    return pages_of(table).select("page_id", "reason")


@query(f"WITH {PAGES} SELECT page_id, title, md5('# ' || title || chr(10) || chr(10) || body) AS digest FROM r WHERE ({GATE}) IS NULL AND body <> ''")
def convert_pages(spark, table):
    """Pages that pass the gate, as Markdown documents."""
    kept = pages_of(table).where("reason is null and body <> ''")
    return kept.select("page_id", "title", F.md5(F.concat(F.lit("# "), "title", F.lit("\n\n"), "body")).alias("digest"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'License|Lizenz|version 3')")
def keyword_any_filter(spark, table):
    return table("documents").where(C.contains_any(F.col("text"), ("License", "Lizenz", "version 3"))).select("doc_id")


@query(
    """SELECT lang AS license, source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY lang, source"""
)
def license_groups(spark, table):
    return table("documents").groupBy(F.col("lang").alias("license"), "source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


TIER = "CASE WHEN length(text) >= 3000 THEN '1' WHEN length(text) >= 800 THEN '2' ELSE '3' END"


@query(f"SELECT {TIER} AS tier, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(ceil(length(text) / 500.0)) AS BIGINT) AS n_chunks FROM documents GROUP BY 1")
def tier_counts(spark, table):
    n = F.length("text")
    tier = F.when(n >= 3000, "1").when(n >= 800, "2").otherwise("3")
    return table("documents").groupBy(tier.alias("tier")).agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_chars"), F.sum(F.ceil(n / 500)).alias("n_chunks"))


@query(
    """SELECT source, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) FILTER (length(text) = 0) AS n_empty FROM documents GROUP BY source ORDER BY bytes DESC, source LIMIT 30"""
)
def acq_report(spark, table):
    """Sources by size, the 30 largest: a report."""
    rows = table("documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.count(F.when(F.length("text") == 0, 1)).alias("n_empty"))
    return rows.orderBy(F.desc("bytes"), "source").limit(30)


CLASS = """CASE WHEN text IS NULL THEN 'missing' WHEN length(text) = 0 THEN 'empty' WHEN regexp_matches(lower(substr(text, 1, 200)), 'error|not found|forbidden|access denied')
AND NOT regexp_matches(lower(substr(text, 1, 200)), '<!doctype html|<html') THEN 'bad' ELSE 'ok' END"""


_SUFFIX = "list_value('html', 'txt', 'xml', 'pdf')[length({0}) % 4 + 1]"
_MARKS = " ".join(f"WHEN contains(head, '{m}') THEN 'error page: {m}'" for m in C.ERROR_MARKS)


@query(
    f"""WITH f AS (SELECT 'p' || page_id || '.' || {_SUFFIX.format('url')} AS local_path, html AS content, length(url) % 9 = 0 AS gone FROM pages
  UNION ALL SELECT 'd' || doc_id || '.' || {_SUFFIX.format("coalesce(text, '')")}, CASE WHEN length(text) % 11 = 0 THEN '' ELSE text END, length(coalesce(text, '')) % 9 = 0 FROM documents),
h AS (SELECT local_path, CASE WHEN gone THEN NULL ELSE content END AS content, split_part(local_path, '.', 2) AS suffix, lower(substr(regexp_replace(content, '^\\s+', ''), 1, 200)) AS head FROM f),
p AS (SELECT local_path, coalesce(length(content), 0) AS size, CASE WHEN content IS NULL THEN 'missing' WHEN content = '' THEN 'empty' WHEN suffix = 'pdf' THEN NULL
  WHEN suffix = 'html' THEN NULL {_MARKS} WHEN suffix = 'xml' THEN 'broken XML' END AS problem FROM h)
SELECT coalesce(problem, 'ok') AS class, count(*) AS n, CAST(sum(size) AS BIGINT) AS n_chars, coalesce(array_to_string(list(local_path ORDER BY local_path) FILTER (problem IS NOT NULL)[1:5], ','), '') AS examples FROM p GROUP BY 1"""
)
def acq_problems(spark, table):
    """Pages and texts as fetched files of several kinds: tallies by problem, with the first five of each."""
    suffix = lambda c: F.element_at(F.array(*map(F.lit, ("html", "txt", "xml", "pdf"))), F.length(c) % 4 + 1)
    text = F.coalesce("text", F.lit(""))
    pages = table("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("."), suffix("url")).alias("local_path"), F.col("html").alias("content"), (F.length("url") % 9 == 0).alias("gone"))
    docs = table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("."), suffix(text)).alias("local_path"), F.when(F.length("text") % 11 == 0, "").otherwise(F.col("text")).alias("content"), (F.length(text) % 9 == 0).alias("gone"))
    files = pages.unionByName(docs)
    registry = files.select("local_path", F.lit("ok").alias("status"))
    told = C.audit(registry, files.where("not gone")).withColumn("class", F.coalesce("problem", F.lit("ok")))
    first = F.row_number().over(Window.partitionBy("class").orderBy("local_path")) <= 5
    few = told.where("problem is not null").withColumn("first", first).where("first").groupBy("class").agg(F.array_join(F.array_sort(F.collect_list("local_path")), ",").alias("examples"))
    sums = told.groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("n_chars"))
    return sums.join(few, "class", "left").select("class", "n", "n_chars", F.coalesce("examples", F.lit("")).alias("examples"))


@query(f"SELECT class, count(*) AS n, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM (SELECT text, {CLASS} AS class FROM documents UNION ALL SELECT html, {CLASS.replace('text', 'html')} FROM pages) GROUP BY class")
def acq_validate(spark, table):
    """Documents and pages by what their contents look like."""
    both = table("documents").select("text").unionByName(table("pages").select(F.col("html").alias("text")))
    return both.groupBy(C.content_class(F.col("text")).alias("class")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))


@query(
    f"""WITH {PAGES}, u AS (SELECT 'page' AS kind, page_id AS id, body AS text FROM r WHERE body <> '' UNION ALL SELECT 'document', doc_id, text FROM documents WHERE length(text) > 0)
SELECT kind, count(*) AS n, count(DISTINCT md5(text)) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM u GROUP BY kind"""
)
def docs_union(spark, table):
    pages = pages_of(table).where("body <> ''").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("body").alias("text"))
    docs = table("documents").where(F.length("text") > 0).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return pages.unionByName(docs).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct(F.md5("text")).alias("n_texts"), F.sum(F.length("text")).alias("n_chars"))


@query(
    f"""WITH {PAGES}, u AS (SELECT 0 AS o, 'pages' AS adapter, page_id AS id, body AS text FROM r UNION ALL SELECT 1, 'documents', doc_id, text FROM documents),
k AS (SELECT *, {FINGER} AS print FROM u WHERE {_strip_sql("text")} <> ''), d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY print ORDER BY o, id) = 1)
SELECT adapter, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM d GROUP BY adapter"""
)
def convert_all(spark, table):
    """Adapters by name, copies once, and what each has given."""
    adapters = {
        "pages": lambda: pages_of(table).select(F.col("page_id").alias("id"), F.col("body").alias("text")),
        "documents": lambda: table("documents").select(F.col("doc_id").alias("id"), "text"),
    }
    return C.convert(adapters).groupBy("adapter").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) BETWEEN 80 AND 2000 AND NOT regexp_matches(text, '[#$%&*]{3}')")
def baike_filter(spark, table):
    """Entries of a fair length without noise."""
    kept = table("documents").where(F.length("text").between(80, 2000) & ~F.col("text").rlike("[#$%&*]{3}"))
    return kept.select("doc_id", F.length("text").cast("long").alias("n"))


HITS = " + ".join(f"CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END" for w in STRONG)


@query(
    f"""WITH c AS (SELECT doc_id, text, ({HITS}) * 10 + CAST(least(length(text), 800) // 100 AS BIGINT) AS score FROM documents WHERE length(text) BETWEEN 80 AND 2000),
u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1), t AS (SELECT * FROM u ORDER BY score DESC, doc_id LIMIT 200)
SELECT CAST('0x' || substr(md5(text), 1, 4) AS BIGINT) % 48 AS volume, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY doc_id)) AS digest FROM t GROUP BY 1"""
)
def baike_topn(spark, table):
    """The 200 best entries, copies once, bound in volumes by hash: a report of limited size."""
    n = F.length("text")
    score = C.count_keywords(F.col("text"), STRONG) * 10 + F.floor(F.least(n, F.lit(800)) / 100)
    rows = table("documents").where(n.between(80, 2000)).select("doc_id", "text", score.alias("score"), F.md5("text").alias("sha"))
    best = M.first_by_key(rows, ["sha"], ["doc_id"]).orderBy(F.desc("score"), "doc_id").limit(200)
    volume = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x.text)
    return best.groupBy(hash_bucket(F.col("text"), 48).alias("volume")).agg(F.count("*").alias("n"), F.md5(F.array_join(volume, "\n")).alias("digest"))


# ------------------------------------------------------------------ conversations


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_user_turn(spark, table):
    return M.latest(table("conversations").where("role = 'user'"), ["conv_id"], ["turn"]).select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 6 AS closing FROM conversations")
def turn_closing_flag(spark, table):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table("conversations").select("conv_id", "turn", (F.count(F.when(F.col("role") == "assistant", 1)).over(before) >= 6).alias("closing"))


LINE = "CASE role WHEN 'user' THEN '用户：' || text WHEN 'assistant' THEN '助手：' || text END"


@query(
    f"""WITH t AS (SELECT conv_id, string_agg({LINE}, chr(10) ORDER BY turn) AS t FROM conversations WHERE role <> 'system' AND length(regexp_replace(text, '\\s+', '', 'g')) > 0 GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(t) > 6000 THEN '……（前文略）' || chr(10) || right(t, 6000) ELSE t END AS transcript FROM t"""
)
def render_transcript(spark, table):
    line = F.concat(F.when(F.col("role") == "user", "用户：").otherwise("助手："), "text")
    rows = table("conversations").where((F.col("role") != "system") & (strip(F.col("text")) != ""))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x.line), "\n")
    text = rows.groupBy("conv_id").agg(whole.alias("t"))
    return text.select("conv_id", F.when(F.length("t") > 6000, F.concat(F.lit("……（前文略）\n"), F.right("t", F.lit(6000)))).otherwise(F.col("t")).alias("transcript"))
