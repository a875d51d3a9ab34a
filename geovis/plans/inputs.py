"""Input tables of the jobs, derived row by row from the given tables.

The given tables hold no robots files, sitemaps, JSON-LD, usage rows or model replies. These
expressions build them from every row of `pages`, `conversations`, `documents`, `events`,
`orders`, `lineitem` and `customer`, so the work grows with the tables. They are plain SQL that
means the same in Spark and in DuckDB; the reference queries use the very same text.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geovis.session import configure

NOW = "2024-06-01T00:00:00"
BRANDS = 997

ORIGIN = "regexp_extract(url, '^(https?://[^/]*)', 1)"
MAISON = f"('Maison ' || CAST(page_id % {BRANDS} AS STRING))"


def _pick(key: str, *cases: str, default: str = "''") -> str:
    whens = " ".join(f"WHEN {i} THEN {case}" for i, case in enumerate(cases))
    return f"(CASE {key} {whens} ELSE {default} END)"


def _times(text: str, count: str) -> str:
    return f"repeat({text}, CAST({count} AS INT))"


def _jsonld(body: str) -> str:
    return f"'<script type=\"application/ld+json\">' || {body} || '</script>'"


def escaped(text: str) -> str:
    """The text as the inside of a JSON string."""
    back = "chr(92)"
    out = f"replace({text}, {back}, {back} || {back})"
    out = f"replace({out}, '\"', {back} || '\"')"
    for code in range(1, 32):
        out = f"replace({out}, chr({code}), {back} || 'u{code:04x}')"
    return out


def said(key: str) -> str:
    """The text of a conversation row, ended by what a careless reader trips over (quotes that close
    the field, a fence with an object, escapes, rare characters), as the inside of a JSON string."""
    hostile = _pick(
        f"{key} % 5",
        "'\"}], \"choices\": [], \"verdict\": \"'",
        "chr(10) || '```' || chr(10) || '{\"brand_mentioned\": false}' || chr(10) || '```'",
        "' ' || chr(92) || '\" ' || chr(92) || 'u0041 ' || chr(92) || chr(92)",
        "' ☃ 😀\u2028 ' || chr(7) || chr(9)",
    )
    return escaped(f"(coalesce(text, '') || {hostile})")


_HEAD = " || ".join(
    [
        _pick(
            "page_id % 3",
            "'<meta name=\"viewport\" content=\"width=device-width, initial-scale=1\">'",
            "'<META content=''initial-scale=1'' name=viewport>'",
        ),
        _pick(
            "page_id % 4",
            f"'<meta name=\"description\" content=\"' || {_times(chr(39) + 'mot clair ' + chr(39), '11 + page_id % 7')} || '\">'",
            "'<meta name=\"description\" content=\"court &amp; net\">'",
            "'<meta name=\"description\" content=\"\">'",
        ),
        _pick(
            "page_id % 5",
            f"'<meta property=\"og:site_name\" content=\"' || {MAISON} || '\"><meta property=\"og:locale\" content=\"fr_FR\">'",
            "'<meta property=\"og:title\" content=\"A\"><meta property=\"og:title\" content=\"B\"><meta property=\"og:type\" content=\"\">'",
            "'<meta name=\"twitter:card\" content=\"summary\"><link rel=\"alternate\" hreflang=\"fr\" href=\"/fr/\">'",
            "'<link rel=\"alternate\" hreflang=\"fr\" href=\"/fr/\"><link rel=\"alternate\" hreflang=\"en\" href=\"/en/\"><link rel=\"alternate\" hreflang=\"\" href=\"/x/\">'",
        ),
        "(CASE WHEN page_id % 2 = 0 THEN '<link rel=\"canonical\" href=\"' || url || '\">' ELSE '' END)",
        _pick(
            "page_id % 12",
            _jsonld(f"'{{\"@context\":\"https://schema.org\",\"@type\":\"Organization\",\"name\":\"' || {MAISON} || '\",\"url\":\"' || {ORIGIN} || '\",\"logo\":\"/l.png\"}}'"),
            _jsonld(f"'{{\"@type\":\"Organization\",\"name\":\"' || {MAISON} || '\",\"url\":0}}'"),
            _jsonld("'{\"@graph\":[{\"@type\":\"Organization\",\"name\":\"\",\"url\":\"x\"},{\"@type\":[\"FAQPage\",\"WebPage\"]},3]}'"),
            _jsonld(f"'[{{\"@type\":\"hotel\",\"name\":\" ' || {MAISON} || ' \",\"address\":{{\"x\":1}},\"telephone\":\"+33\",\"openingHours\":\"Mo\"}},{{\"@type\":\"BreadcrumbList\"}}]'"),
            _jsonld("'{\"@type\":\"Restaurant\",\"address\":\"\",\"telephone\":\"0102\",\"openingHoursSpecification\":[]}'"),
            _jsonld("'{\"@type\": Organization}'"),
            _jsonld("'{\"@type\":\"Product\",\"aggregateRating\":{\"ratingValue\":\"4.6\",\"reviewCount\":12}}'") + " || "
            + _jsonld("'{\"@type\":\"AggregateRating\",\"ratingValue\":3.2,\"ratingCount\":\"7\"}'"),
            _jsonld("'  '"),
            _jsonld("'[{\"@type\":\"Article\"},{\"@type\":\"Review\",\"name\":5}]'"),
            _jsonld("'{\"@type\":\"Service\",\"review\":true}'") + " || " + _jsonld("'{bad'"),
        ),
    ]
)

_TOP = " || ".join(
    [
        "'<a href=\"' || url || '\">self</a>'",
        _pick(
            "page_id % 4",
            "'<a href=\"/services/conseil/\">S</a><a href=\"contact\">C</a>'",
            "'<a href=\"/img/logo.png\">l</a><a href=\"mailto:x@y.z\">m</a><a href=\"/faq#a\">F</a><a href=\"//other.example.com/x\">o</a>'",
            "'<a href=''/blog/a&amp;b/''>B</a><a class=x href=\"?q=1\">q</a>'",
        ),
        _pick("page_id % 7", "'<div class=\"nav lang-switcher\">x</div>'", "'<a href=\"/de/start\">D</a>'"),
    ]
)

_END = " || ".join(
    [
        _times("'<h2>Comment choisir une maison au calme ?</h2><p>Pour bien choisir, venez voir.</p>'", "page_id % 4"),
        _times("'<h2>Nos offres</h2><p>Texte</p>'", "page_id % 6"),
        _times("'<h3>What does it cost in <em>high</em> season</h3> <div class=\"a\">It depends.</div>'", "page_id % 3"),
        "(CASE WHEN page_id % 5 = 1 THEN '<h3>Pourquoi ici?</h3><ul><li>a</li></ul><h4>Notes</h4>' ELSE '' END)",
        _times("'<img src=\"a.png\" alt=\"Vue du jardin\">'", "page_id % 5"),
        _times("'<img src=\"b.png\">'", "page_id % 3"),
        "(CASE WHEN page_id % 6 = 0 THEN '<img alt=\"ab\" src=c.png>' ELSE '' END)",
        "(CASE WHEN page_id % 4 = 3 THEN " + _times("' mot'", "600") + " ELSE '' END)",
        _pick(
            "page_id % 5",
            "'<a href=\"https://www.instagram.com/maison\">i</a>'",
            "'<a href=\"https://www.linkedin.com/company/m\">l</a><a href=\"https://x.com/m\">x</a><a href=\"https://facebook.com/m\">f</a>'",
            "'<a href=\"https://youtube.com/@/m\">y</a>'",
        ),
        _pick(
            "page_id % 6",
            "'<iframe src=\"https://www.google.com/maps/embed?pb=1\"></iframe>'",
            "'<a href=\"https://goo.gl/maps/abc\">map</a>'",
        ),
        _pick("page_id % 7", "'<p>F.A.Q. et plus</p>'", "'<p>Frequently  asked</p>'"),
        _pick("page_id % 8", "'<p>12 rue de la Paix, 01 02 03 04 05</p>'", "'<p>Hotel et spa</p>'", "'<p>Lire le blog</p>'"),
        _pick("page_id % 25", "'<p>Just a moment...</p>'", "'<p>Access denied by Akamai</p>'", "'<div id=\"root\"></div>'"),
    ]
)

_LF = "chr(10)"
_ROBOTS = _pick(
    "page_id % 9",
    f"'User-agent: *' || {_LF} || 'Allow: /' || {_LF} || 'Sitemap: ' || {ORIGIN} || '/sitemap.xml'",
    f"'User-agent: GPTBot' || {_LF} || 'User-agent: ClaudeBot' || {_LF} || 'Disallow: /' || {_LF} || {_LF} || 'User-agent: *' || {_LF} || 'Disallow: /admin'",
    f"'# rules' || {_LF} || 'User-agent: *' || chr(13) || {_LF} || 'Disallow:' || {_LF} || '# split' || {_LF} || 'Allow: /'",
    f"'User-agent: Google-Extended' || {_LF} || 'Disallow: / # all' || {_LF} || 'ALLOW : /' || {_LF} || 'User-agent: PerplexityBot' || {_LF} || 'Disallow: /'",
    f"'Disallow: /' || {_LF} || 'User-agent: gptbot' || {_LF} || 'Disallow: /' || {_LF} || 'no colon here' || {_LF} || 'User-agent: anthropic-ai' || {_LF} || 'Allow: /x'",
    f"'User-agent: *' || {_LF} || 'Disallow: /' || {_LF} || {_LF} || {_LF} || 'User-agent: Claude-Web' || {_LF} || 'Allow: /'",
    "''",
    default="CAST(NULL AS STRING)",
)
_ROBOTS_STATUS = _pick("page_id % 9", "200", "200", "200", "200", "500", "200", "200", "404", default="CAST(NULL AS INT)")


def _entry(path: str, lastmod: str | None) -> str:
    date = f" || '<lastmod>{lastmod}</lastmod>'" if lastmod else ""
    return f"'<url><loc> ' || {ORIGIN} || '{path}</loc>'{date} || '</url>'"


_SITEMAP = _pick(
    "page_id % 8",
    f"'<sitemapindex><sitemap><loc>' || {ORIGIN} || '/a.xml</loc></sitemap><sitemap><loc>' || {ORIGIN} || '/b.xml</loc></sitemap></sitemapindex>'",
    f"'<urlset>' || {_entry('/', '2024-05-01')} || {_times(_entry('/en/page5', '2023-01-01'), 'page_id % 4')} || {_times(_entry('/services', '2024-03-15T10:00:00Z'), 'page_id % 3')} || '</urlset>'",
    f"'<urlset>' || {_entry('/a/b/c/d/e', None)} || {_times(_entry('/a/b/c/d', None), 'page_id % 5')} || '</urlset>'",
    "'<urlset></urlset>'",
    "'Not a sitemap'",
    f"'<urlset>' || {_times(_entry('/x/y', 'never'), '90 + page_id % 20')} || {_entry('/About/', '2024-05-30')} || '</urlset>'",
    f"'<urlset>' || {_entry('/img/a', '2024-05-02')} || {_entry('/b5', '2024-05-03')} || {_times(_entry('/c', '2020-01-01'), 'page_id % 3')} || '</urlset>'",
    default="CAST(NULL AS STRING)",
)
_SITEMAP_STATUS = _pick("page_id % 8", "200", "200", "200", "200", "200", "200", "500", default="404")

_LLMS = _pick(
    "page_id % 6",
    f"'# ' || {MAISON} || {_LF} || '> Resume' || {_LF} || '## Pages' || {_LF} || " + _times(f"'- [a](' || {ORIGIN} || '/services/x/)' || {_LF}", "page_id % 8"),
    f"'# T' || {_LF} || '- [h](' || {ORIGIN} || '/a/b/c/d) et [r](/rel)'",
    f"'## Only' || {_LF} || '> quote'",
    "'texte nu'",
    "''",
    default="CAST(NULL AS STRING)",
)

SITE_SQL = f"""
SELECT page_id AS site_id, url,
  replace(replace(html, '</head>', {_HEAD} || '</head>'), '<body>', '<body>' || {_TOP}) || {_END} AS home_html,
  CASE WHEN page_id % 13 = 0 THEN 503 ELSE 200 END AS home_status,
  CASE page_id % 3 WHEN 0 THEN 'fetch' WHEN 1 THEN 'jina' ELSE 'browserless' END AS home_method,
  {_ROBOTS} AS robots_txt, {_ROBOTS_STATUS} AS robots_status,
  {_SITEMAP} AS sitemap_xml, {_SITEMAP_STATUS} AS sitemap_status,
  {_LLMS} AS llms_txt,
  CASE WHEN page_id % 3 = 0 THEN 'full text' ELSE NULL END AS llms_full_txt,
  page_id % 5 <> 0 AS http_probe_ok
FROM pages
"""

# Addresses ending in 5 do not respond; those ending in /c were never probed.
PROBE_OK = "NOT (url LIKE '%5')"
PROBE_KNOWN = "NOT (url LIKE '%/c')"

PAGE_FETCH_SQL = """
SELECT page_id, url, html,
  CASE page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 0 ELSE 200 END AS status,
  page_id % 11 > 2 AS ok,
  'fetch' AS method,
  page_id % 4 <> 3 AS md_tested,
  CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE NULL END AS md_status,
  CASE WHEN page_id % 8 = 4 THEN '' ELSE '# md' END AS md_content
FROM pages
"""

SEARCH_SQL = f"""
SELECT 'Maison ' || CAST(doc_id % {BRANDS} AS STRING) AS brand,
  CASE doc_id % 4 WHEN 0 THEN 'press' WHEN 1 THEN 'reddit' WHEN 2 THEN 'reviews' ELSE 'sectoral' END AS kind,
  text || repeat(' MAISON ' || CAST(doc_id % {BRANDS} AS STRING) || '.', CAST(doc_id % 7 AS INT)) AS text
FROM documents
"""

# Every document is the French or the English article of a brand.
ARTICLE_SQL = f"""
SELECT 'Maison ' || CAST(doc_id % {BRANDS} AS STRING) AS brand,
  CASE WHEN CAST(floor(doc_id / {BRANDS}) AS BIGINT) % 2 = 0 THEN 'fr' ELSE 'en' END AS lang,
  CASE WHEN doc_id % 7 = 0 THEN 'disambiguation' ELSE 'standard' END AS type,
  CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 9 = 0 THEN NULL ELSE text END AS extract
FROM documents
"""

CAPTURE_SQL = """
SELECT url || '#' || CAST(page_id AS STRING) AS url, 'fetch' AS method, page_id % 5 <> 4 AS ok,
  CASE WHEN page_id % 5 = 4 THEN 0 ELSE 200 END AS status,
  CASE WHEN page_id % 3 = 0 THEN '<html lang="fr"><head><title>t</title></head><body><div id="root"></div></body></html>' ELSE html END AS html
FROM pages
UNION ALL
SELECT url || '#' || CAST(page_id AS STRING), 'jina', page_id % 4 <> 1, 200,
  CASE WHEN page_id % 7 = 0 THEN '<body>short</body>' ELSE html END
FROM pages WHERE page_id % 6 <> 5
UNION ALL
SELECT url || '#' || CAST(page_id AS STRING), 'browserless', page_id % 2 = 0, CASE WHEN page_id % 2 = 0 THEN 200 ELSE 0 END, html
FROM pages WHERE page_id % 5 <> 2
"""

RESOURCE_SQL = f"""
SELECT page_id AS site_id, 'robots' AS kind, {_ROBOTS_STATUS} AS status, coalesce({_ROBOTS}, 'gone') AS content FROM pages
UNION ALL
SELECT page_id, 'sitemap', {_SITEMAP_STATUS}, coalesce({_SITEMAP}, 'gone') FROM pages WHERE page_id % 10 <> 9
UNION ALL
SELECT page_id, 'llms', CASE WHEN page_id % 6 = 5 THEN 410 ELSE 200 END, coalesce({_LLMS}, 'gone') FROM pages
"""

# An audit per conversation, a question and its answer per assistant turn.
ANSWER_SQL = """
SELECT conv_id * 1000 + turn AS response_id, conv_id AS audit_id,
  CAST(floor((turn - 1) / 2) AS INT) + 1 AS position,
  CASE CAST(conv_id + floor(turn / 2) AS BIGINT) % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'perplexity' ELSE 'gemini' END AS provider,
  CASE WHEN (conv_id + turn) % 13 = 0 THEN '' ELSE
    text || CASE WHEN conv_id % 4 = 0 THEN ' Voir https://www.maison' || CAST(conv_id AS STRING) || '.fr/a, Supplier#000000001 et Supplier#000000007.' ELSE '' END END AS text,
  CASE WHEN (conv_id + turn) % 17 = 0 THEN 'HTTP 503' ELSE NULL END AS error
FROM conversations WHERE role = 'assistant'
"""

BRAND_SQL = """
SELECT conv_id AS audit_id,
  CASE conv_id % 7 WHEN 0 THEN 'tionre' WHEN 1 THEN 'Keiten' WHEN 2 THEN 'of thee' WHEN 3 THEN 'eauxmentis' WHEN 4 THEN 'qu' WHEN 5 THEN 'withn' ELSE 'Zebra (Paris)' END AS brand_name,
  CASE conv_id % 3 WHEN 0 THEN 'thator' WHEN 1 THEN 'in' ELSE 'andthen' END AS alias,
  'maison' || CAST(conv_id AS STRING) || '.fr' AS domain
FROM conversations WHERE turn = 0
"""

# What the analysing model returned for an answer: well formed, fenced, or broken.
ANALYSIS_SQL = f"""
SELECT conv_id * 1000 + turn AS response_id,
  CASE (conv_id + turn) % 11
    WHEN 9 THEN '{{"brand_mentioned": "yes", "sources_cited": ["a", 1, null], "mention_context": ["' || {said('turn')} || '"]}}'
    WHEN 10 THEN CASE conv_id % 3 WHEN 0 THEN 'no json' WHEN 1 THEN '{{"brand_mentioned": true, "mention_context": "' || coalesce(text, '') || '"}}' ELSE '{{"brand_mentioned": true}} ' || coalesce(text, '') END
    ELSE CASE WHEN conv_id % 3 = 0 THEN '```json' || chr(10) ELSE '' END
      || '{{"brand_mentioned": ' || CASE WHEN (conv_id + turn) % 3 = 0 THEN 'false' ELSE 'true' END
      || ', "mention_position": ' || CASE WHEN (conv_id * 7 + turn) % 6 = 5 THEN 'null' WHEN (conv_id + turn) % 23 = 7 THEN '1.5' ELSE CAST((conv_id * 7 + turn) % 6 AS STRING) END
      || ', "mention_context": "' || {said('conv_id + turn')} || '", "brand_citation_present": ' || CASE WHEN (conv_id + turn) % 4 = 0 THEN 'true' ELSE 'false' END
      || ', "sentiment": ' || CASE (conv_id * 5 + turn) % 5 WHEN 0 THEN 'null' WHEN 1 THEN '"negative"' WHEN 2 THEN '"neutral"' WHEN 3 THEN '"positive"' ELSE CASE WHEN conv_id % 10 = 1 THEN '"great"' ELSE '"positive"' END END
      || ', "competitors_cited": [' || CASE WHEN conv_id % 2 = 0 THEN '" Supplier ' || CAST((conv_id + turn) % 5 AS STRING) || '", "Supplier ' || CAST(turn % 3 AS STRING) || '", "Supplier 0", " "' ELSE '"Supplier ' || CAST(conv_id % 4 AS STRING) || '"' END || ']'
      || ', "sources_cited": []}}' || CASE WHEN conv_id % 3 = 0 THEN chr(10) || '```' ELSE '' END
  END AS completion
FROM conversations WHERE role = 'assistant'
"""

USAGE_SQL = """
SELECT event_id, user_id, user_id % 20 AS audit_id,
  CASE event_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'perplexity' ELSE 'gemini' END AS provider,
  CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN 'openai/gpt-4o' ELSE 'gpt-4o-mini-2024-07-18' END
    WHEN 1 THEN CASE WHEN event_id % 5 = 0 THEN 'anthropic/claude-haiku-4-5' ELSE 'claude-sonnet-4-5' END
    WHEN 2 THEN 'sonar' ELSE CASE WHEN event_id % 7 = 0 THEN 'mystery-1' ELSE 'gemini-2.5-flash' END END AS model,
  CAST(floor(value * 100) AS BIGINT) AS tokens_in,
  CAST(length(props) * 37 + user_id AS BIGINT) AS tokens_out,
  CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 50 AS DOUBLE) / 1000 ELSE 0.0 END AS actual_cost_usd,
  CASE event_type WHEN 'view' THEN 'visibility_query' WHEN 'click' THEN 'mention_analysis' WHEN 'purchase' THEN 'synthesis' WHEN 'error' THEN 'test' ELSE 'brand_extraction' END AS request_type,
  ts AS created_at
FROM events
"""

# A ledger over many months: one row per order, priced at a 200,000th of its value.
LEDGER_SQL = """
SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS user_id,
  o_custkey % 40 AS audit_id,
  CAST(o_orderkey % 1000 AS BIGINT) AS tokens_in, CAST(o_custkey % 500 AS BIGINT) AS tokens_out,
  CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 0.000004 AS DECIMAL(10,6)) AS cost_usd,
  CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 0.000005 AS DECIMAL(10,6)) AS cost_eur,
  o_orderdate AS created_at
FROM orders
"""

REQUEST_SQL = """
SELECT page_id AS request_id,
  CASE page_id % 9 WHEN 0 THEN '{"url": "' || url || '"'
    WHEN 1 THEN '{"url": "' || url || '", "geo_target": 5}'
    WHEN 2 THEN '{"url": "not a url"}'
    WHEN 3 THEN '{"geo_target": "Paris"}'
    WHEN 4 THEN '{"url": "' || url || '", "geo_target": null}'
    ELSE '{"url": "' || url || '", "geo_target": "Lyon"}' END AS body
FROM pages
"""

CHAT_SQL = f"""
SELECT conv_id * 1000 + turn AS response_id, 'perplexity/sonar' AS model,
  CASE WHEN conv_id % 9 = 8 THEN 503 ELSE 200 END AS status,
  CASE WHEN conv_id % 9 = 8 THEN 'busy ' || text WHEN conv_id % 9 = 7 THEN CASE turn % 4 WHEN 1 THEN '{{"choices": []}}' ELSE '{{"choices": [{{"message": {{"content": "' || coalesce(text, '') END ELSE
  '{{"id":"x","model":"m","choices":[{{"message":{{"role":"assistant","content":"' || {said('conv_id + turn')} || '"'
  || CASE WHEN conv_id % 4 = 0 THEN ',"annotations":[{{"type":"url_citation","url_citation":{{"url":"https://a.fr/' || CAST(turn AS STRING) || '","title":"T"}}}},{{"type":"link","url":"https://b.fr"}}]' ELSE '' END
  || '}}}}],"usage":{{"prompt_tokens":' || CAST(length(text) AS STRING) || ',"completion_tokens":' || CASE WHEN conv_id % 7 = 6 THEN '"many"' ELSE CAST(turn * 3 AS STRING) END
  || CASE WHEN conv_id % 2 = 0 THEN ',"cost":0.00' || CAST(1 + conv_id % 9 AS STRING) ELSE '' END || '}}'
  || CASE WHEN conv_id % 5 = 0 THEN ',"citations":["https://c.fr","https://d.fr/' || CAST(conv_id AS STRING) || '"]' ELSE '' END || '}}' END AS reply
FROM conversations WHERE role = 'assistant'
"""

PARTS_SQL = f"""
SELECT conv_id * 1000 + turn AS response_id,
  CASE WHEN conv_id % 5 = 0 THEN 'google/unlisted' ELSE 'google/gemini-2.5-flash' END AS model,
  CASE WHEN conv_id % 9 = 8 THEN 429 ELSE 200 END AS status,
  CASE WHEN conv_id % 9 = 8 THEN 'slow down' ELSE
  '{{"candidates":[{{"content":{{"parts":[{{"text":"' || {said('conv_id + turn')} || '"}},{{"text":""}},{{"text":' || CASE WHEN conv_id % 7 = 6 THEN '["b"]' ELSE '"b"' END || '}}]}}'
  || CASE WHEN conv_id % 3 = 0 THEN ',"groundingMetadata":{{"groundingChunks":[{{"web":{{"uri":"https://g.fr/' || CAST(turn AS STRING) || '","title":"G"}}}},{{"web":{{"title":"no uri"}}}},{{}}]}}' ELSE '' END
  || '}}],"usageMetadata":{{"promptTokenCount":' || CAST(length(text) AS STRING) || ',"candidatesTokenCount":' || CAST(turn * 5 AS STRING) || '}}}}' END AS reply
FROM conversations WHERE role = 'assistant'
"""


def _list(prefix: str, count: int) -> str:
    items = ", ".join(f'"{prefix} {i}"' for i in range(count))
    return f"[{items}]"


QUESTION_JSON_SQL = f"""
SELECT conv_id AS audit_id,
  CASE conv_id % 6 WHEN 5 THEN '{{"branded": []}}' WHEN 4 THEN '{{"branded": {_list("b", 10)}, "service": {_list("s", 9)}, "comparative": [{_list("c", 9)[1:-1]}, 10]}}'
  ELSE '{{"branded": {_list("avis", 10)}, "service": {_list("Quel service a Lyon", 10)}, "comparative": ["' || {said('conv_id')} || '", ' || '{_list("mieux que", 9)[1:]}}}' END AS completion
FROM conversations WHERE turn = 0
"""

BUSINESS_JSON_SQL = f"""
SELECT conv_id AS audit_id, 'maison' || CAST(conv_id AS STRING) || '.fr' AS domain,
  CASE conv_id % 5 WHEN 4 THEN '{{"brand_name": "' || {said('conv_id')} || '"' WHEN 3 THEN '{{"brand_name":"M","brand_aliases":[],"industry":null,"services":[],"geo_zone":null,"detected_competitors":[],"language":"pt"}}'
  ELSE '```' || chr(10) || '{{"brand_name":"Maison ' || CAST(conv_id AS STRING) || '","brand_aliases":["La Maison","M' || CAST(conv_id AS STRING) || '"],"industry":' || CASE WHEN conv_id % 2 = 0 THEN 'null' ELSE '"' || {said('conv_id')} || '"' END
    || ',"services":["spa","' || {said('conv_id + 1')} || '"],"geo_zone":"Lyon","detected_competitors":["Supplier 1"],"language":"en"}}' || chr(10) || '```' END AS completion
FROM conversations WHERE turn = 0
"""


def _recommendations(count: int, impact: str) -> str:
    one = '{{"priority":"{p}","category":"schema","title":"T{i}","description":"D","impact_score":{s}}}'
    names = ["quick_win", "medium", "long_term"]
    return ",".join(one.format(p=names[i % 3], i=i, s=impact) for i in range(count))


_ADVICE = (
    "{\"priority\":\"medium\",\"category\":\"content\",\"title\":\"' || "
    + said("conv_id + 1") + " || '\",\"description\":\"' || " + said("conv_id + 2") + " || '\",\"impact_score\":9}"
)

SYNTHESIS_JSON_SQL = f"""
SELECT conv_id AS audit_id,
  CASE conv_id % 5 WHEN 4 THEN '{{"verdict":7,"top_competitor":null,"recommendations":[{_recommendations(1, "5")}]}}'
  WHEN 3 THEN '{{"verdict":"v","top_competitor":null,"recommendations":[{_recommendations(5, "11")},{{"title":"' || {said('conv_id')} || '"}}]}}'
  ELSE '{{"verdict":"' || {said('conv_id')} || '","top_competitor":"Supplier 1","recommendations":[{_recommendations(6, "7")},{_ADVICE}]}}' END AS completion
FROM conversations WHERE turn = 0
"""

# Owners, audits, questions, answers and analyses out of customers, orders and line items.
AUDIT_SQL = "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS status FROM orders"
CHILD_SQL = "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS audit_id, l_linenumber AS position, l_suppkey FROM lineitem"
RESPONSE_SQL = "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey * 10 + l_linenumber AS query_id, l_quantity AS score FROM lineitem"
ANALYSIS_ROW_SQL = "SELECT l_orderkey * 10 + l_linenumber AS response_id, l_returnflag AS flag FROM lineitem"

# The twelve stored tables, one per name: (given table, its rows).
STORED_SQL = {
    "profiles": ("customer", "SELECT c_custkey AS id, lower(c_mktsegment) || CAST(CAST(floor(c_custkey / 2) AS INT) AS STRING) AS email, CASE WHEN c_nationkey < 20 THEN 'client' WHEN c_nationkey < 23 THEN 'admin' ELSE 'guest' END AS role FROM customer"),
    "audits": ("orders", "SELECT o_orderkey AS id, o_custkey * 2 AS user_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'done' ELSE 'paused' END AS status, CAST(floor(o_totalprice / 3000) AS INT) AS progress FROM orders"),
    "audit_business_info": ("documents", "SELECT doc_id AS audit_id, 'Maison ' || lang AS brand_name FROM documents"),
    "audit_technical": ("lineitem", "SELECT l_orderkey AS audit_id, CASE l_linenumber WHEN 1 THEN 'foundations' WHEN 2 THEN 'geo_triptych' WHEN 3 THEN 'structured_data' WHEN 4 THEN 'content' WHEN 5 THEN 'authority' WHEN 6 THEN 'content' ELSE 'other' END AS category, CAST(floor(l_quantity / 2) AS INT) AS score FROM lineitem"),
    "queries": ("lineitem", "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS audit_id, l_linenumber AS position, CASE l_linenumber % 4 WHEN 0 THEN 'branded' WHEN 1 THEN 'service' WHEN 2 THEN 'comparative' ELSE 'mixed' END AS category FROM lineitem"),
    "ai_responses": ("lineitem", "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey * 10 + CAST(floor((l_linenumber + 1) / 2) AS INT) AS query_id, CASE l_returnflag WHEN 'N' THEN 'openai' WHEN 'R' THEN 'gemini' ELSE 'mistral' END AS provider FROM lineitem"),
    "ai_response_analysis": ("lineitem", "SELECT l_orderkey * 10 + l_linenumber + 3 AS response_id, CASE l_returnflag WHEN 'N' THEN 'neutral' WHEN 'R' THEN 'great' ELSE NULL END AS sentiment FROM lineitem"),
    "audit_scores": ("pages", "SELECT page_id AS audit_id, length(html) % 120 AS technical_score, length(url) AS visibility_score, CASE WHEN page_id % 9 = 0 THEN NULL ELSE length(url) + 60 END AS global_score FROM pages"),
    "audit_recommendations": ("conversations", "SELECT conv_id * 1000 + turn AS id, conv_id AS audit_id, CASE role WHEN 'user' THEN 'quick_win' WHEN 'assistant' THEN 'long_term' ELSE role END AS priority, turn AS impact_score FROM conversations"),
    "api_usage": ("events", "SELECT event_id AS id, user_id, event_id * 5 AS audit_id FROM events"),
    "email_captures": ("supplier", "SELECT s_suppkey AS id, s_suppkey * 400 AS audit_id, s_name AS email FROM supplier"),
    "rate_limits": ("events", "SELECT event_id AS id, CASE event_type WHEN 'view' THEN NULL ELSE user_id END AS audit_id, event_type AS action FROM events"),
}

STATE_SQL = """
SELECT user_id AS audit_id, ts AS event_ts, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'scraping' WHEN 'click' THEN 'querying' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'analyzing' END AS status,
  CAST(event_id % 100 AS INT) AS progress, 'step ' || event_type AS current_step,
  'failed with ' || props AS error_message, 'fr' AS language
FROM events
"""


# Tables whose rows hold long texts, on which the work per row is high.
TEXT_TABLES = {"pages", "documents", "conversations"}


SPREAD_BELOW = 8


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a small file of costly rows: one that Spark reads in fewer than
    SPREAD_BELOW splits, so at most that many splits are ever moved."""
    few = df.rdd.getNumPartitions() < SPREAD_BELOW
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if few else df


# A page takes about 15 milliseconds of one core, so a task of this many rows takes some seconds.
PAGES_PER_TASK = 400


def dealt(df: DataFrame, key: str, rows_per_task: int = PAGES_PER_TASK) -> DataFrame:
    """The rows of a table on which the work per row is high, dealt over tasks of as many rows each.
    Files hold few, large and uneven splits, and one split would be one long task. The number of rows
    is read from the files' footers."""
    tasks = max(df.count() // rows_per_task, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, key)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return dealt(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")


def over_views(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """An input expression over some tables. They are views under names of their own for as long as
    the expression is read, so that none of the user's views is replaced."""
    views = {name: f"geovis_{name}_{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.createOrReplaceTempView(views[name])
        sql = re.sub(rf"\bFROM {name}\b", f"FROM {views[name]}", sql)
    try:
        return spark.sql(sql)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def derive(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return over_views(spark, sql, {name: read(spark, sf_dir, name) for name in names})


def sites(spark, sf_dir) -> DataFrame:
    return over_views(spark, SITE_SQL, {"pages": pages(spark, sf_dir)})


def url_status(spark, sf_dir) -> DataFrame:
    """Probe results of every address in the sitemaps, one row per address."""
    from geovis.operators.sitemaps import sitemap_entries

    locs = sitemap_entries(sites(spark, sf_dir)).select(F.col("loc").alias("url")).distinct()
    return locs.filter(F.expr(PROBE_KNOWN)).withColumn("ok", F.expr(PROBE_OK)).withColumn(
        "status", F.when(F.col("ok"), 200).otherwise(404)
    )


def page_captures(spark, sf_dir) -> DataFrame:
    """Fetched pages with `urls`, the addresses that links lead to."""
    from geovis.functions import urls as U

    own = over_views(spark, PAGE_FETCH_SQL, {"pages": pages(spark, sf_dir)})
    origin = U.origin(F.col("url"))
    linked = U.resolve_link(F.col("url"), origin)
    service = F.when(F.col("page_id") % 4 == 0, F.concat(origin, F.lit("/services/conseil")))
    return own.withColumn("urls", F.array_compact(F.array(linked, service)))


def measures(spark, sf_dir) -> DataFrame:
    """Measures of fetched pages, one row per address: HTML is read once and reduced to numbers
    before the shuffle; of several fetches the first counts."""
    from geovis.operators.facts import page_measures

    rows = page_measures(page_captures(spark, sf_dir), keep=["page_id", "urls"])
    fields = ["status", "ok", "method", "words", "md_tested", "md_ok"]
    rows = rows.select(F.explode("urls").alias("url"), "page_id", *fields)
    return rows.groupBy("url").agg(F.min_by(F.struct(*fields), "page_id").alias("m")).select("url", "m.*")


def brands(spark, sf_dir) -> DataFrame:
    """Brand dictionary with aliases and known competitors."""
    rows = derive(spark, sf_dir, BRAND_SQL, "conversations")
    return rows.withColumn("aliases", F.array("alias")).drop("alias")
