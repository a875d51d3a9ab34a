"""Reference SQL for DuckDB, one statement per registered query.

Written independently of the operators: relational where they work within the row, and one
pattern per tag where they use back-references.
"""

from __future__ import annotations

from geovis.functions import money as M
from geovis.functions.text import ANSWER_OPENINGS
from geovis.operators.facts import (
    ADDRESS_WORDS, BLOG_WORDS, LANGUAGE_LINK, LANGUAGE_SWITCH, MAP_EMBED, MAP_LINK, PHONE,
    SOCIAL_PATTERNS, TRAVEL_WORDS,
)
from geovis.operators.robots import AI_BOTS
from geovis.operators.sitemaps import PRIORITY_PATHS
from geovis.plans import catalog as K
from geovis.plans import inputs as I

# Fixed values, stated again here so that a slip in the library's lists shows.
QUESTION_WORDS = [
    "qui", "que", "quoi", "quand", "comment", "pourquoi", "combien", "ou", "est-ce", "peut-on", "peut-il", "peut-elle",
    "what", "how", "why", "when", "where", "who", "which", "can", "do", "does", "is", "are",
]
ASSET_SUFFIXES = [
    "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "css", "js", "json", "pdf", "xml", "zip", "mp4", "webm", "woff", "woff2",
]

WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SEP = WS[:-1] + r""".,;:!?'"()\[\]/\\-]+"""
ATTRS = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*?"""
TAG = rf"""</?[A-Za-z!]{ATTRS}>"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x, pattern, to=""):
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def has(x, pattern):
    return f"regexp_matches({x}, {q(pattern)})"


def find(x, pattern, group=1):
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def find_all(x, pattern, group=1):
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def trim(x):
    return sub(x, f"^{WS}+|{WS}+$")


def collapse(x):
    return trim(sub(x, f"{WS}+", " "))


def jslen(x):
    return f"(length({x}) + length({sub(x, r'[^\x{10000}-\x{10FFFF}]')}))"


def decode(x):
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, {q(name)}, {q(char)})"
    return x


def drop(x, *names):
    for name in names:
        x = sub(x, rf"(?is)<{name}\b[^>]*>.*?(?:</{name}\s*>|\z)")
    return x


def clean(x):
    return trim(decode(sub(x, TAG)))


def attr(tag, name):
    pattern = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return decode(f"({find(tag, pattern, 1)} || {find(tag, pattern, 2)} || {find(tag, pattern, 3)})")


def tags(x, name):
    return find_all(x, rf"(?i)(<{name}\b{ATTRS}>)")


def each(items, body, var="x"):
    return f"list_transform({items}, lambda {var}: {body})"


def keep(items, test, var="x"):
    return f"list_filter({items}, lambda {var}: {test})"


def first(items):
    return f"({items})[1]"


def any_of(items, test, var="x"):
    return f"(len({keep(items, test, var)}) > 0)"


def words_re(words, flags="(?i)"):
    return rf"{flags}\b(?:{'|'.join(words)})\b"


def rnd(x):
    return f"CAST(floor({x} + 0.5) AS INT)"


def body(x):
    return f"(CASE WHEN {has(x, r'(?i)<body\b')} THEN regexp_replace({x}, {q(r'(?is)\A.*?<body\b[^>]*>')}, '') ELSE {sub(x, r'(?is)<head\b.*?(?:</head\s*>|\z)')} END)"


def is_question(x):
    t = trim(x)
    return f"({t} LIKE '%?' OR ({jslen(t)} > 20 AND {has(t, words_re(QUESTION_WORDS))}))"


def opens(x):
    t = trim(f"coalesce({x}, '')")
    return f"({t} <> '' AND {jslen(t)} < 250 AND {has(t, '(?i)^(?:' + '|'.join(ANSWER_OPENINGS) + r')\b')})"


def pct(x):
    """Percent-encode what is no printable ASCII."""
    unsafe = r"""[^\x21-\x7E]|["<>`{}]"""
    return f"array_to_string(list_transform(string_split({x}, ''), lambda ch: CASE WHEN {has('ch', unsafe)} THEN url_encode(ch) ELSE ch END), '')"


IS_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#:@<>\[\]\\^|%]+(?::\d*)?(?:[/?#]|\s*$)"


def host(u):
    return f"lower({find(u, r'^[A-Za-z]+://([^/?#:]*)')})"


def origin(u):
    return f"lower({find(u, r'^([A-Za-z]+://[^/?#]*)')})"


def path(u):
    raw = find(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)")
    return f"(CASE WHEN {raw} = '' THEN '/' ELSE {pct(raw)} END)"


def query(u):
    return pct(find(u, r"^[^?#]*(\?[^#]+)"))


def normal(u):
    return sub(f"({origin(u)} || {path(u)} || {query(u)})", "/$")


def link(href, org):
    absolute = (
        f"CASE WHEN {has(href, '(?i)^[a-z][a-z0-9+.-]*://')} THEN {href} WHEN {has(href, '(?i)^[a-z][a-z0-9+.-]*:')} THEN NULL "
        f"WHEN {href} LIKE '//%' THEN 'http:' || {href} WHEN {href} LIKE '/%' THEN {org} || {href} ELSE {org} || '/' || {href} END"
    )
    return absolute


SITE = f"site AS ({I.SITE_SQL})"

_plain = sub("home_html", r"(?s)<!--.*?(?:-->|\z)")
STAGED = f"""plain AS (SELECT *, {_plain} AS p FROM site),
staged AS (SELECT *, {drop('p', 'script', 'style')} AS m FROM plain)"""


def heads(name):
    return keep(each(find_all("m", rf"(?is)<{name}\b[^>]*>(.*?)(?:</{name}\s*>|\z)"), clean("x")), "x <> ''")


_META = each(tags("m", "meta"), f"{{'name': {attr('x', 'name')}, 'property': {attr('x', 'property')}, 'content': {attr('x', 'content')}, 'has': {has('x', r'(?i)\scontent(?:[\s=/>]|\z)')}}}")
_LINK = each(tags("m", "link"), f"{{'rel': {attr('x', 'rel')}, 'lang': {attr('x', 'hreflang')}, 'href': {attr('x', 'href')}}}")
_ANSWER = r"(?is)<h[23]\b[^>]*>(.*?)(?:</h[23]\s*>|\z)(?:\s*<p\b[^>]*>(.*?)(?:</p\s*>|\z)|\s*<div\b[^>]*>(.*?)(?:</div\s*>|\z))?"

SIGNALS = f"""{SITE}, {STAGED},
tagged AS (SELECT *, {_META} AS metas, {_LINK} AS links_, {find('m', r'(?is)\A(.*?)(?:</head\s*>|<body\b|\z)')} AS head FROM staged),
sig AS (SELECT *,
  nullif({trim(decode(find('head', r'(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\z)')))}, '') AS title,
  {trim(first(keep('metas', "x.name = 'description'")) + '.content')} AS description,
  {first(keep('links_', "x.rel = 'canonical'"))}.href AS canonical,
  {first(keep('metas', "x.name = 'viewport'"))}.content AS viewport,
  nullif({attr(find('m', rf'(?i)(<html\b{ATTRS}>)'), 'lang')}, '') AS lang,
  {keep('metas', "starts_with(x.property, 'og:') AND x.property <> 'og:' AND x.content <> ''")} AS og,
  {keep('metas', "starts_with(x.name, 'twitter:') AND x.name <> 'twitter:' AND x.content <> ''")} AS twitter,
  {keep('links_', "x.rel = 'alternate' AND x.lang <> '' AND x.href <> ''")} AS hreflang,
  {heads('h1')} AS h1, {heads('h2')} AS h2, {heads('h3')} AS h3, {heads('h4')} AS h4,
  {each(find_all('m', _ANSWER, 1), clean('x'))} AS ah,
  {each(find_all('m', _ANSWER, 2), clean("coalesce(x, '')"))} AS ap, {each(find_all('m', _ANSWER, 3), clean("coalesce(x, '')"))} AS ad,
  {tags('m', 'img')} AS imgs,
  {collapse(decode(sub(body(drop('m', 'noscript', 'svg')), TAG)))} AS vtext,
  {collapse(decode(sub(body(drop(drop('m', 'noscript'), 'nav', 'header', 'footer')), TAG)))} AS mtext
  FROM tagged)"""


def last_of(items, test, field="content"):
    return f"list_last({keep(items, test)}).{field}"


def words(x):
    return f"CAST(CASE WHEN {x} = '' THEN 0 ELSE length({x}) - length(replace({x}, ' ', '')) + 1 END AS INT)"


LINKS = f"""hrefs AS (SELECT site_id, url, unnest({keep(each(tags('m', 'a'), trim(attr('x', 'href'))), "x <> ''")}) AS href,
  generate_subscripts({keep(each(tags('m', 'a'), trim(attr('x', 'href'))), "x <> ''")}, 1) AS n FROM staged),
absolute AS (SELECT site_id, url, n, {link('href', origin('url'))} AS a FROM hrefs),
resolved AS (SELECT site_id, url, n, {normal('a')} AS link FROM absolute WHERE a IS NOT NULL AND {has('a', IS_URL)} AND {host('a')} = {host('url')}),
links AS (SELECT site_id, any_value(url) AS url, link, min(n) AS n FROM resolved GROUP BY site_id, link)"""

_PRIORITY = [r"/(services?|prestations?|offres?)/", r"/(a-propos|about|qui-sommes-nous)\b", r"/(faq|questions?)\b", r"/(contact)\b", r"/(blog|news|actualit)"]
SAMPLE = f"""candidates AS (SELECT * FROM links WHERE NOT {has('link', '(?i)[.](?:' + '|'.join(ASSET_SUFFIXES) + ')$')} AND link <> {origin('url')} || {path('url')}),
ranked AS (SELECT site_id, link, n, least({', '.join(f"CASE WHEN {has('link', p)} AND n = min(n) FILTER (WHERE {has('link', p)}) OVER (PARTITION BY site_id) THEN {i} ELSE 99 END" for i, p in enumerate(_PRIORITY))}) AS pr FROM candidates),
sample AS (SELECT site_id, link, row_number() OVER (PARTITION BY site_id ORDER BY pr, n) - 1 AS ord FROM ranked QUALIFY ord < 5)"""

# -- JSON-LD -------------------------------------------------------------------------------

_LD = r"(?is)<script type=\"application/ld\+json\">(.*?)(?:</script\s*>|\z)"
_LD_LIST = keep(find_all("p", _LD), f"{trim('x')} <> ''")
BLOCKS = f"""blocks AS (SELECT site_id, unnest({_LD_LIST}) AS raw, generate_subscripts({_LD_LIST}, 1) - 1 AS ord FROM plain)"""


def field(o, name):
    return f"json_extract({o}, '$.\"{name}\"')"


def truthy(o, name):
    v = field(o, name)
    return (
        f"coalesce(CASE json_type({v}) WHEN 'NULL' THEN false WHEN 'VARCHAR' THEN json_extract_string({o}, '$.\"{name}\"') <> '' "
        f"WHEN 'BOOLEAN' THEN CAST({v} AS VARCHAR) = 'true' WHEN 'OBJECT' THEN true WHEN 'ARRAY' THEN true ELSE TRY_CAST(CAST({v} AS VARCHAR) AS DOUBLE) <> 0 END, false)"
    )


def unfold_json(src, cols, value, out):
    """Array elements in order, or the value itself."""
    as_list = f"CASE WHEN json_type({value}) = 'ARRAY' THEN CAST({value} AS JSON[]) ELSE [CAST({value} AS JSON)] END"
    return f"{out} AS (SELECT {cols}, unnest({as_list}) AS v, generate_subscripts({as_list}, 1) AS i FROM {src})"


_TYPE = field("o", "@type")
OBJECTS = f"""{BLOCKS}, parsed AS (SELECT site_id, ord AS b, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM blocks),
{unfold_json("(SELECT * FROM parsed WHERE j IS NOT NULL)", "site_id, b", "j", "entries_")},
graphs AS (SELECT site_id, b, i AS e, CASE WHEN json_type(json_extract(v, '$."@graph"')) = 'ARRAY' THEN json_extract(v, '$."@graph"') ELSE json_array(v) END AS g FROM entries_ WHERE json_type(v) = 'OBJECT'),
{unfold_json("graphs", "site_id, b, e", "g", "members")},
objs AS (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY b, e, i) - 1 AS ord, v AS o FROM members WHERE json_type(v) = 'OBJECT'),
typed AS (SELECT *, CASE json_type({_TYPE}) WHEN 'VARCHAR' THEN [lower(json_extract_string(o, '$."@type"'))]
    WHEN 'ARRAY' THEN list_transform(CAST({_TYPE} AS JSON[]), lambda x: lower(json_extract_string(x, '$'))) ELSE CAST([] AS VARCHAR[]) END AS types,
  CASE WHEN json_type({field('o', 'name')}) = 'VARCHAR' THEN nullif({trim("json_extract_string(o, '$.name')")}, '') END AS name,
  CASE WHEN json_type({field('o', 'aggregateRating')}) = 'OBJECT' THEN {field('o', 'aggregateRating')} WHEN json_extract_string(o, '$."@type"') = 'AggregateRating' THEN o END AS ar FROM objs),
obj AS (SELECT site_id, ord, types, name, {truthy('o', 'name')} AS has_name, {truthy('o', 'url')} AS has_url, {truthy('o', 'logo')} AS has_logo,
  {truthy('o', 'address')} AS has_address, {truthy('o', 'telephone')} AS has_phone,
  ({truthy('o', 'openingHours')} OR {truthy('o', 'openingHoursSpecification')}) AS has_hours,
  ({truthy('o', 'aggregateRating')} OR {truthy('o', 'review')}) AS has_rating,
  TRY_CAST(json_extract_string(ar, '$.ratingValue') AS DOUBLE) AS rating,
  nullif(TRY_CAST(coalesce(json_extract_string(ar, '$.reviewCount'), json_extract_string(ar, '$.ratingCount'), '0') AS BIGINT), 0) AS reviews FROM typed)"""


def typed(*names):
    return "list_has_any(types, [" + ", ".join(q(n.lower()) for n in names) + "])"


_LOCAL = ("LocalBusiness", "Hotel", "Restaurant", "Store", "BedAndBreakfast", "Resort", "TouristAttraction", "LodgingBusiness")
_OWNERS = ("Organization", "Hotel", "LocalBusiness", "Restaurant", "Resort", "LodgingBusiness")


def n_filled(cond, *flags):
    total = " + ".join(f"{f}::INT" for f in flags)
    return f"coalesce(arg_min({total}, ord) FILTER (WHERE {cond}), 0)"


SCHEMA = f"""schema_facts AS (SELECT site_id,
  count(*) FILTER (WHERE {typed('Organization')}) AS org_count, {n_filled(typed('Organization'), 'has_name', 'has_url', 'has_logo')} AS org_filled,
  count(*) FILTER (WHERE {typed(*_LOCAL)}) AS local_count, {n_filled(typed(*_LOCAL), 'has_address', 'has_phone', 'has_hours')} AS local_filled,
  count(*) FILTER (WHERE {typed('Product', 'Service', 'Offer')}) AS offering_count, count(*) FILTER (WHERE {typed('FAQPage', 'QAPage')}) AS faq_schema_count,
  count(*) FILTER (WHERE {typed('Review', 'AggregateRating')}) AS review_count, count(*) FILTER (WHERE has_rating) AS embedded_ratings,
  count(*) FILTER (WHERE {typed('BreadcrumbList')}) AS breadcrumb_count, count(*) FILTER (WHERE {typed('Article', 'BlogPosting', 'NewsArticle')}) AS article_count,
  max(rating) AS best_rating, CAST(coalesce(sum(reviews), 0) AS BIGINT) AS rating_total,
  arg_min(name, ord) FILTER (WHERE name IS NOT NULL AND {typed(*_OWNERS)}) AS brand_in_schema FROM obj GROUP BY site_id),
block_facts AS (SELECT site_id, count(*) AS block_count, count(*) FILTER (WHERE j IS NULL) AS block_errors FROM parsed GROUP BY site_id)"""

# -- resources -----------------------------------------------------------------------------

_LINES = r"string_split_regex(robots_txt, '\r?\n')"
ROBOTS = f"""raw_lines AS (SELECT site_id, unnest({_LINES}) AS raw, generate_subscripts({_LINES}, 1) AS n FROM site WHERE robots_txt IS NOT NULL),
lines AS (SELECT site_id, n, {trim(sub('raw', '(?s)#.*'))} AS line FROM raw_lines),
numbered AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY n) AS blk FROM lines),
pairs AS (SELECT site_id, n, blk, lower({trim(find('line', '(?s)^([^:]*):'))}) AS k, {trim(find('line', '(?s)^[^:]*:(.*)$'))} AS v FROM numbered WHERE contains(line, ':')),
rules AS (SELECT site_id, v AS agent, 'agent' AS kind, '' AS value FROM pairs WHERE k = 'user-agent'
  UNION ALL SELECT r.site_id, a.v, r.k, r.v FROM pairs r JOIN pairs a ON a.site_id = r.site_id AND a.blk = r.blk AND a.n < r.n AND a.k = 'user-agent' WHERE r.k IN ('allow', 'disallow')),
agents AS (SELECT site_id, agent, NOT bool_or(kind = 'disallow' AND value IN ('/', '')) OR bool_or(kind = 'allow' AND value IN ('/', '')) AS ok FROM rules GROUP BY site_id, agent)"""
_BOTS = [b for names in AI_BOTS.values() for b in names]
BOTS = f"""bots AS (SELECT s.site_id, s.bot, a.agent IS NOT NULL AS explicit, coalesce(a.ok, w.ok, true) AS allowed
  FROM (SELECT site_id, unnest([{', '.join(q(b) for b in _BOTS)}]) AS bot FROM site) s
  LEFT JOIN agents a ON a.site_id = s.site_id AND a.agent = s.bot LEFT JOIN agents w ON w.site_id = s.site_id AND w.agent = '*')"""

_URLS = keep(find_all("sitemap_xml", r"(?is)<url>(.*?)</url>"), has("x", r"(?is)<loc>.*?</loc>"))
SITEMAP = f"""xml AS (SELECT *, coalesce({has('sitemap_xml', '(?i)<sitemapindex')}, false) AS is_index FROM site),
entry_blocks AS (SELECT site_id, unnest({_URLS}) AS x, generate_subscripts({_URLS}, 1) - 1 AS ord FROM xml WHERE sitemap_xml IS NOT NULL AND NOT is_index),
entries AS (SELECT site_id, ord, {trim(find('x', '(?is)<loc>(.*?)</loc>'))} AS loc, nullif({trim(find('x', '(?is)<lastmod>(.*?)</lastmod>'))}, '') AS lastmod FROM entry_blocks),
depths AS (SELECT *, CASE WHEN {has('loc', IS_URL)} THEN len({keep("string_split(" + path('loc') + ", '/')", "x <> ''")}) ELSE 0 END AS depth,
  ord < 10 AND {has('lower(loc)', IS_URL)} AND {path('lower(loc)')} IN ({', '.join(q(p) + ', ' + q(p + '/') for p in PRIORITY_PATHS)}) AS prio,
  coalesce(TRY_CAST(lastmod AS TIMESTAMP) > TIMESTAMP '{I.NOW.replace('T', ' ')}' - INTERVAL 180 DAY, false) AS recent FROM entries),
map_agg AS (SELECT site_id, count(*) AS n, count(lastmod) AS dated, count(*) FILTER (WHERE recent) AS recent, max(depth) AS dmax, avg(depth) AS davg, bool_or(prio) AS prio FROM depths GROUP BY site_id),
maps AS (SELECT x.site_id, x.is_index AS sitemap_is_index,
  CASE WHEN x.is_index THEN len({find_all('sitemap_xml', r'(?is)<sitemap>.*?<loc>(.*?)</loc>')}) ELSE 0 END AS sitemap_children,
  coalesce(n, 0) AS sitemap_entries, coalesce(dated, 0) AS sitemap_dated, coalesce(recent, 0) AS sitemap_recent,
  coalesce(dmax, 0) AS sitemap_depth_max, coalesce(davg, 0.0) AS sitemap_depth_avg, coalesce(prio, false) AS sitemap_priority,
  CASE WHEN coalesce(sitemap_xml, '') = '' OR NOT contains(sitemap_xml, '<') THEN 'empty or not XML'
    WHEN NOT x.is_index AND coalesce(n, 0) = 0 THEN 'no URL and no child sitemap' END AS sitemap_error
  FROM xml x LEFT JOIN map_agg USING (site_id)),
probe_sample AS (SELECT site_id, loc, row_number() OVER (PARTITION BY site_id ORDER BY md5('0|' || loc), loc) AS r FROM entries QUALIFY r <= 3),
probes AS (SELECT site_id, count(*) AS probed, count(*) FILTER (WHERE loc NOT LIKE '%/c' AND loc NOT LIKE '%5') AS probed_ok FROM probe_sample GROUP BY site_id)"""

_LLMS_LINKS = each(find_all("llms_txt", r"\[.+?\]\((https?://[^)]+)\)"), sub("x", "/$"))
LLMS = f"""llms_parts AS (SELECT site_id, {has('llms_txt', r'(?m)^#\s+\w')} AS h1, {has('llms_txt', r'(?m)^>\s+\w')} AS quote,
  len({find_all('llms_txt', r'(?m)^##\s+\w', 0)}) AS sections, len({find_all('llms_txt', r'\[.+?\]\(.+?\)', 0)}) AS links, {_LLMS_LINKS} AS abs_links FROM site WHERE llms_txt IS NOT NULL),
llms_cover AS (SELECT l.site_id, l.n, bool_or(starts_with(l.link, {sub('e.loc', '/$')})) AS hit FROM (SELECT site_id, unnest(abs_links) AS link, generate_subscripts(abs_links, 1) AS n FROM llms_parts) l JOIN entries e USING (site_id) GROUP BY l.site_id, l.n),
llms AS (SELECT p.site_id, h1, quote, sections, links, len(abs_links) AS absolute_links,
  {rnd("(CASE WHEN h1 THEN 1.0 ELSE 0 END + CASE WHEN quote THEN 0.5 ELSE 0 END + CASE WHEN sections >= 1 THEN 0.5 ELSE 0 END + CASE WHEN links >= 5 THEN 1.0 WHEN links >= 1 THEN 0.5 ELSE 0 END)")} AS points,
  coalesce((SELECT count(*) FROM llms_cover c WHERE c.site_id = p.site_id AND c.hit), 0) AS covered FROM llms_parts p)"""

# -- lookups -------------------------------------------------------------------------------

_PAGE_MAIN = collapse(decode(sub(body(drop(drop(drop(sub("html", r"(?s)<!--.*?(?:-->|\z)"), "script", "style"), "noscript"), "nav", "header", "footer")), TAG)))
MEASURES = f"""fetched AS ({I.PAGE_FETCH_SQL}),
fetched_urls AS (SELECT * REPLACE ({normal('url')} AS url) FROM fetched UNION ALL SELECT * REPLACE ({origin('url')} || '/services/conseil' AS url) FROM fetched WHERE page_id % 4 = 0),
measures AS (SELECT url, status, ok, method, CASE WHEN ok AND html <> '' THEN {words(_PAGE_MAIN)} END AS words, md_tested, md_status = 200 AND md_content <> '' AS md_ok
  FROM fetched_urls QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)"""
SAMPLED = f"""sampled_facts AS (SELECT s.site_id, count(*) AS sampled, count(*) FILTER (WHERE m.status >= 400) AS sampled_errors,
  count(*) FILTER (WHERE m.md_tested) AS md_tested, count(*) FILTER (WHERE m.md_tested AND m.md_ok) AS md_found,
  count(*) FILTER (WHERE {has('s.link', '(?i)service|prestation|offre')} AND m.words IS NOT NULL) AS service_pages,
  avg(m.words) FILTER (WHERE {has('s.link', '(?i)service|prestation|offre')}) AS service_words,
  coalesce(string_agg(DISTINCT m.method, '|' ORDER BY m.method), '') AS sampled_methods
  FROM sample s LEFT JOIN measures m ON m.url = s.link GROUP BY s.site_id)"""
SEARCH = f"""results AS ({I.SEARCH_SQL}),
counted AS (SELECT brand, kind, CAST((length(lower(text)) - length(replace(lower(text), lower(brand), ''))) / length(brand) AS BIGINT) AS n FROM results),
mention_counts AS (SELECT brand, {', '.join(f"CAST(coalesce(sum(n) FILTER (WHERE kind = '{k}'), 0) AS BIGINT) AS mentions_{k}" for k in ('press', 'reddit', 'reviews', 'sectoral'))} FROM counted GROUP BY brand)"""
ARTICLES = f"""articles AS ({I.ARTICLE_SQL}),
wiki AS (SELECT brand, bool_or(lang = 'fr' AND type <> 'disambiguation' AND coalesce(extract, '') <> '') AS wiki_fr, bool_or(lang = 'en' AND type <> 'disambiguation' AND coalesce(extract, '') <> '') AS wiki_en FROM articles GROUP BY brand)"""

_SEPARATOR = r"(?s)\A(.*?)\s*[|·•—-]"
_BRAND = f"""coalesce(brand_in_schema, nullif({last_of('og', "x.property = 'og:site_name'")}, ''),
  CASE WHEN {has('title', _SEPARATOR)} THEN {trim(find('title', _SEPARATOR))} ELSE {trim('title')} END, '')"""
_SHELL_TEXT = trim(sub(sub(sub("home_html", r"(?is)<script.*?</script>"), r"(?is)<style.*?</style>"), r"<[^>]+>", " "))
_SHELL = f"""(home_html = '' OR contains(lower(home_html), '__next_data__') OR {has('home_html', r'(?i)<div id="root"\s*>\s*</div>')} OR {has('home_html', r'(?i)<div id="__nuxt"\s*>\s*</div>')} OR length({_SHELL_TEXT}) < 500)"""
_WALL = f"""CASE WHEN {has('home_html', '(?i)vercel security checkpoint')} THEN 'Vercel Security Checkpoint' WHEN {has('home_html', r'(?i)just a moment\.{3}')} THEN 'Cloudflare challenge'
  WHEN {has('home_html', '(?i)cf-browser-verification')} THEN 'Cloudflare browser verification' WHEN {has('home_html', r'(?i)attention required! \| cloudflare')} THEN 'Cloudflare attention required'
  WHEN {has('home_html', r'(?is)access denied.{0,200}akamai')} THEN 'Akamai access denied' WHEN {has('home_html', '(?i)please enable javascript and cookies to continue')} THEN 'Generic JS challenge' END"""

_H23 = "list_concat(h2, h3)"
_SOCIAL = " + ".join(f"{has('home_html', p)}::INT" for p in SOCIAL_PATTERNS)
_FAQ_RE = r"(?i)\bf\.?a\.?q\b|\bquestions?\s*frequentes\b|\bfrequently\s*asked\b"
_SENT = keep("string_split_regex(vtext, '[.!?]+')", f"{jslen(trim('x'))} > 5")


def bot_any(check, flag):
    names = ", ".join(q(b) for b in AI_BOTS[check])
    return f"(SELECT bool_or({flag}) FROM bots b WHERE b.site_id = s.site_id AND b.bot IN ({names}))"


_BOT_COLUMNS = ", ".join(f"{bot_any(c, 'allowed')} AS {c}_a, {bot_any(c, 'explicit')} AS {c}_n" for c in AI_BOTS)

FACT_CTES = ", ".join([SIGNALS, LINKS, SAMPLE, OBJECTS, SCHEMA, ROBOTS, BOTS, SITEMAP, LLMS, MEASURES, SAMPLED, SEARCH, ARTICLES])
FACTS = f"""WITH {FACT_CTES},
own AS (SELECT s.*, {_BRAND} AS brand, sf.* EXCLUDE (site_id, brand_in_schema), coalesce(bf.block_count, 0) AS block_count, coalesce(bf.block_errors, 0) AS block_errors,
  mp.* EXCLUDE (site_id), l.points AS llms_points, l.absolute_links, l.covered, {_BOT_COLUMNS},
  coalesce(pr.probed, 0) AS probed, coalesce(pr.probed_ok, 0) AS probed_ok, coalesce(sm.sampled, 0) AS sampled, coalesce(sm.sampled_errors, 0) AS sampled_errors,
  coalesce(sm.md_tested, 0) AS mdt, coalesce(sm.md_found, 0) AS mdf, coalesce(sm.service_pages, 0) AS service_pages, sm.service_words, sm.sampled_methods
  FROM sig s LEFT JOIN schema_facts sf USING (site_id) LEFT JOIN block_facts bf USING (site_id) LEFT JOIN maps mp USING (site_id) LEFT JOIN llms l USING (site_id)
  LEFT JOIN probes pr USING (site_id) LEFT JOIN sampled_facts sm USING (site_id)),
f AS (SELECT o.*, coalesce(c.mentions_press, 0) AS press, coalesce(c.mentions_reddit, 0) AS reddit, coalesce(c.mentions_reviews, 0) AS reviews_n, coalesce(c.mentions_sectoral, 0) AS sectoral,
  coalesce(w.wiki_fr, false) AS wiki_fr, coalesce(w.wiki_en, false) AS wiki_en,
  coalesce(sitemap_status = 200, false) AND coalesce(sitemap_xml, '') <> '' AS map_ok, coalesce(sitemap_xml, '') <> '' AS map_text,
  coalesce(robots_status = 200, false) AND coalesce(robots_txt, '') <> '' AS rob_ok, coalesce(llms_txt, '') <> '' AS has_llms,
  starts_with(url, 'https') AND home_status = 200 AS https,
  (coalesce(local_count, 0) > 0 OR ({has('lower(home_html)', words_re(ADDRESS_WORDS, ''))} AND {has('lower(home_html)', PHONE)}) OR {has('lower(home_html)', words_re(TRAVEL_WORDS, ''))}) AS is_local,
  {has('home_html', words_re(BLOG_WORDS))} AS blog, {has('home_html', _FAQ_RE)} AS faq_words,
  ({has('lower(home_html)', LANGUAGE_LINK)} OR {has('lower(home_html)', LANGUAGE_SWITCH)} OR len(hreflang) > 0) AS multi,
  len({keep(_H23, is_question('x'))}) AS hq, len({keep('h2', is_question('x'))}) AS h2q,
  len({keep('ah', is_question('x'))}) AS aq, len({keep("list_zip(ah, ap, ad)", is_question('x[1]') + ' AND ' + opens('x[2] || x[3]'))}) AS aok,
  len(imgs) AS img_n, len({keep('imgs', has('x', r'(?i)\salt(?:[\s=/>]|\z)') + ' AND ' + jslen(trim(attr('x', 'alt'))) + ' > 3')}) AS img_ok,
  {words('mtext')} AS home_words, len({_SENT}) AS sents, {words('vtext')} AS vwords, {jslen("replace(vtext, ' ', '')")} AS vchars,
  ({_SOCIAL}) AS social, {has('home_html', MAP_EMBED)} AS embed, {has('home_html', MAP_LINK)} AS maplink
  FROM own o LEFT JOIN mention_counts c USING (brand) LEFT JOIN wiki w USING (brand))"""


def yes(cond, points, other="fail"):
    return f"CASE WHEN {cond} THEN 'pass' ELSE '{other}' END", f"CASE WHEN {cond} THEN {points} ELSE 0 END"


def grade(points, top, low=1):
    return f"CASE WHEN {points} >= {top} THEN 'pass' WHEN {points} >= {low} THEN 'warn' ELSE 'fail' END", points


def skip(cond, pair):
    return f"CASE WHEN {cond} THEN 'skipped' ELSE {pair[0]} END", f"CASE WHEN {cond} THEN 0 ELSE {pair[1]} END"


def need(cond, pair):
    return f"CASE WHEN {cond} THEN {pair[0]} ELSE 'fail' END", f"CASE WHEN {cond} THEN {pair[1]} ELSE 0 END"


def steps(x, *limits):
    return "(CASE " + " ".join(f"WHEN {x} >= {low} THEN {points}" for low, points in limits) + " ELSE 0 END)"


def ratio(a, b):
    return f"({a}::DOUBLE / nullif({b}, 0))"


_VALID = "(CASE WHEN NOT map_ok OR sitemap_error IS NOT NULL THEN 0 WHEN sitemap_is_index AND sitemap_children > 0 THEN 2 WHEN sitemap_entries = 0 THEN 0 WHEN probed_ok = probed THEN 2 WHEN probed_ok >= probed - 1 THEN 1 ELSE 0 END)"
_COVERS = f"(coalesce({ratio('covered', 'least(sitemap_entries, 10)')}, 0) >= 0.3 OR absolute_links >= 5)"
_SHAPE = "(CASE WHEN NOT map_text OR (sitemap_entries = 0 AND sitemap_children = 0) THEN 0 WHEN sitemap_depth_max <= 3 AND sitemap_depth_avg <= 2 THEN 2 WHEN sitemap_depth_max <= 4 THEN 1 ELSE 0 END)"
_FULL = "(CASE coalesce(local_filled, 0) WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END)"
_TITLE_N, _DESC_N = jslen("coalesce(title, '')"), jslen("coalesce(description, '')")
_FAQ = "(CASE WHEN hq >= 3 AND faq_words THEN 3 WHEN hq >= 3 OR faq_words THEN 2 WHEN hq >= 1 THEN 1 ELSE 0 END)"
_H2R = f"coalesce({ratio('h2q', 'len(h2)')}, 0)"
_CONV = f"(CASE WHEN {_H2R} >= 0.3 THEN 3 WHEN {_H2R} >= 0.15 THEN 2 WHEN {_H2R} > 0 THEN 1 ELSE 0 END)"


def bot_check(c):
    return (f"CASE WHEN NOT rob_ok THEN 'warn' WHEN NOT {c}_a THEN 'fail' WHEN {c}_n THEN 'pass' ELSE 'warn' END", f"CASE WHEN NOT rob_ok OR {c}_a THEN 1 ELSE 0 END")


def outside(col, top, *limits):
    return skip("brand = ''", grade(steps(col, *limits), top))


def _len(x, low, high):
    return f"(CASE WHEN {x} BETWEEN {low} AND {high} THEN 2 WHEN {x} > 0 THEN 1 ELSE 0 END)"


CHECKS = {
    "foundations": [
        ("sitemap_accessible", 3, yes("map_ok", 3)),
        ("sitemap_valid_resolvable", 2, grade(_VALID, 2)),
        ("sitemap_uptodate", 1, need("map_ok", yes("sitemap_dated > 0 AND sitemap_recent * 2 > sitemap_dated", 1, "warn"))),
        ("robots_present", 1, yes("rob_ok", 1)),
        *[(c, 1, bot_check(c)) for c in AI_BOTS],
        ("https_active", 2, yes("https", 2)),
        ("http_to_https_redirect", 1, need("https", yes("http_probe_ok", 1, "warn"))),
        ("cwv_lcp", 2, ("'skipped'", "0")), ("cwv_cls", 1, ("'skipped'", "0")), ("cwv_inp", 1, ("'skipped'", "0")),
        ("mobile_responsive", 1, yes("contains(viewport, 'width=')", 1)),
        ("sample_pages_ok", 1, skip("sampled = 0", yes("sampled_errors = 0", 1))),
    ],
    "geo_triptych": [
        ("llms_txt_present", 4, yes("has_llms", 4)),
        ("llms_txt_structure", 3, need("has_llms", grade("llms_points", 3))),
        ("llms_txt_coverage", 2, need("has_llms", skip("NOT map_text", (yes(_COVERS, 2, "warn")[0], f"CASE WHEN {_COVERS} THEN 2 WHEN absolute_links >= 1 THEN 1 ELSE 0 END")))),
        ("llms_full_txt_present", 2, yes("coalesce(llms_full_txt, '') <> ''", 2, "warn")),
        ("md_versions_pages", 4, skip("mdt = 0", grade(f"(CASE WHEN mdf * 10 >= mdt * 8 THEN 4 WHEN mdf * 10 >= mdt * 5 THEN 3 WHEN mdf * 10 >= mdt * 2 THEN 2 WHEN mdf >= 1 THEN 1 ELSE 0 END)", 3))),
        ("sitemap_logical_structure", 2, grade(_SHAPE, 2)),
        ("sitemap_priority_first", 1, need("map_text", yes("sitemap_priority", 1, "warn"))),
        ("sitemap_segmented", 1, need("map_text", yes("sitemap_entries <= 100 OR sitemap_is_index OR sitemap_children > 0", 1, "warn"))),
        ("hreflang_multilingual", 1, yes("NOT multi OR len(hreflang) >= 2", 1)),
    ],
    "structured_data": [
        ("schema_organization", 3, grade("coalesce(org_filled, 0)", 3)),
        ("schema_local_business", 3, skip("NOT is_local", yes("coalesce(local_count, 0) > 0", 3))),
        ("schema_local_complete", 2, skip("NOT is_local", grade(_FULL, 2))),
        ("schema_product_service", 3, yes("offering_count > 0", 3, "warn")),
        ("schema_faq", 3, yes("faq_schema_count > 0", 3, "warn")),
        ("schema_review_rating", 2, yes("review_count > 0 OR embedded_ratings > 0", 2, "warn")),
        ("schema_breadcrumb", 1, yes("breadcrumb_count > 0", 1, "warn")),
        ("schema_article", 2, skip("NOT blog", yes("article_count > 0", 2, "warn"))),
        ("schema_no_errors", 1, skip("block_count = 0", yes("block_errors = 0", 1))),
    ],
    "content": [
        ("content_h1_unique", 2, grade("(CASE WHEN len(h1) = 1 THEN 2 WHEN len(h1) > 1 THEN 1 ELSE 0 END)", 2)),
        ("content_heading_hierarchy", 2, yes("len(h2) > 0", 2)),
        ("content_title_tag", 2, grade(_len(_TITLE_N, 30, 65), 2)),
        ("content_meta_description", 2, grade(_len(_DESC_N, 110, 165), 2)),
        ("content_faq_structured", 3, grade(_FAQ, 3)),
        ("content_conversational_density", 3, grade(_CONV, 3)),
        ("content_answer_first", 2, skip("aq = 0", grade(f"(CASE WHEN {ratio('aok', 'aq')} >= 0.6 THEN 2 WHEN {ratio('aok', 'aq')} >= 0.3 THEN 1 ELSE 0 END)", 2))),
        ("content_alt_text", 2, skip("img_n = 0", grade(f"(CASE WHEN {ratio('img_ok', 'img_n')} >= 0.8 THEN 2 WHEN {ratio('img_ok', 'img_n')} >= 0.5 THEN 1 ELSE 0 END)", 2))),
        ("content_word_count", 1, yes("(CASE WHEN service_pages > 0 THEN service_words ELSE home_words END) >= 500", 1, "warn")),
        ("content_readability", 1, skip("sents = 0 OR vwords = 0", yes(f"{ratio('vwords', 'sents')} <= 25 AND {ratio('vchars', 'vwords')} <= 6.5", 1, "warn"))),
    ],
    "authority": [
        ("auth_wikipedia", 4, skip("brand = ''", grade("(CASE WHEN wiki_fr AND wiki_en THEN 4 WHEN wiki_fr OR wiki_en THEN 3 ELSE 0 END)", 4, 3))),
        ("auth_press_mentions", 3, outside("press", 3, (6, 3), (3, 2), (1, 1))),
        ("auth_aggregate_rating", 2, grade("(CASE WHEN best_rating >= 4 THEN 2 WHEN best_rating >= 3 THEN 1 ELSE 0 END)", 2)),
        ("auth_reddit", 2, outside("reddit", 2, (4, 2), (1, 1))),
        ("auth_social_profiles", 2, grade(steps("social", (3, 2), (1, 1)), 2)),
        ("auth_review_platforms", 3, outside("reviews_n", 3, (4, 3), (2, 2), (1, 1))),
        ("auth_google_business", 2, grade("(CASE WHEN embed THEN 2 WHEN maplink THEN 1 ELSE 0 END)", 2)),
        ("auth_sectoral", 2, outside("sectoral", 2, (3, 2), (1, 1))),
    ],
}


def check_rows(*categories):
    rows = []
    for cat in categories:
        for check_id, points_max, (status, points) in CHECKS[cat]:
            rows.append(f"{{'category': '{cat}', 'check_id': '{check_id}', 'status': {status}, 'points_earned': CAST({points} AS INT), 'points_max': {points_max}}}")
    return f"unfolded AS (SELECT site_id, unnest([{', '.join(rows)}]) AS r FROM f), checks AS (SELECT site_id, r.* FROM unfolded)"


ALL_CHECKS = f"{FACTS}, {check_rows(*CHECKS)}"
CATEGORY = """cats AS (SELECT site_id, category,
  coalesce(CAST(floor(sum(points_earned) FILTER (WHERE status <> 'skipped')::DOUBLE / sum(points_max) FILTER (WHERE status <> 'skipped') * 20 + 0.5) AS INT), 0) AS score,
  count(*) FILTER (WHERE status = 'pass') AS pass, count(*) FILTER (WHERE status = 'warn') AS warn, count(*) FILTER (WHERE status = 'fail') AS fail, count(*) FILTER (WHERE status = 'skipped') AS skipped
  FROM checks GROUP BY site_id, category),
tech AS (SELECT site_id, """ + ", ".join(f"max(score) FILTER (WHERE category = '{c}') AS {c}" for c in CHECKS) + """, CAST(sum(pass + warn + fail + skipped) AS BIGINT) AS total_checks, CAST(sum(pass) AS BIGINT) AS passed_checks, CAST(sum(score) AS BIGINT) AS technical_score FROM cats GROUP BY site_id)"""

# -- answers -------------------------------------------------------------------------------

ANSWERS = f"answers AS ({I.ANSWER_SQL}), brands AS ({I.BRAND_SQL})"
CANDS = f"""cands AS (SELECT a.response_id, a.text, c.name, c.ord FROM answers a JOIN (SELECT audit_id, brand_name AS name, 0 AS ord FROM brands UNION ALL SELECT audit_id, alias, 1 FROM brands) c USING (audit_id)),
exact_hits AS (SELECT response_id, name, ord, strpos(lower(text), lower(name)) AS at_ FROM cands WHERE length(name) >= 3 AND strpos(lower(text), lower(name)) > 0),
exact AS (SELECT response_id, arg_min(name, at_ * 10 + ord) AS matched, min(at_) AS at_ FROM exact_hits GROUP BY response_id),
missed AS (SELECT * FROM answers WHERE response_id NOT IN (SELECT response_id FROM exact)),
token_lists AS (SELECT response_id, {keep("string_split_regex(text, " + q(SEP) + ")", "x <> ''")} AS t FROM missed WHERE text <> ''),
words_ AS (SELECT response_id, unnest(t) AS w, generate_subscripts(t, 1) AS n, 0 AS pair FROM token_lists),
pairs_ AS (SELECT a.response_id, a.w || ' ' || b.w AS w, a.n, 1 AS pair FROM words_ a JOIN words_ b ON a.response_id = b.response_id AND b.n = a.n + 1),
fuzzy_hits AS (SELECT c.response_id, c.name, w.w, c.ord, w.pair, w.n FROM (SELECT * FROM words_ UNION ALL SELECT * FROM pairs_) w JOIN cands c USING (response_id)
  WHERE length(c.name) >= 5 AND (pair = 0 OR contains(c.name, ' ')) AND abs({jslen('w.w')} - length(c.name)) <= (CASE WHEN length(c.name) < 8 THEN 1 ELSE 2 END)
  AND levenshtein(lower(w.w), lower(c.name)) <= (CASE WHEN length(c.name) < 8 THEN 1 ELSE 2 END)),
fuzzy AS (SELECT response_id, name AS matched, w AS original FROM fuzzy_hits QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY ord, pair, n) = 1)"""


def js(name):
    return f"json_extract(j, '$.{name}')"


def jtype(name):
    return f"coalesce(json_type({js(name)}), '')"


def jstr(name):
    return f"json_extract_string(j, '$.{name}')"


def text_list(name):
    return f"({jtype(name)} = 'ARRAY' AND len(list_filter(CAST({js(name)} AS JSON[]), lambda x: json_type(x) <> 'VARCHAR')) = 0)"


def as_list(name):
    return f"list_transform(CAST({js(name)} AS JSON[]), lambda x: json_extract_string(x, '$'))"


def loaded(sql, extra=""):
    body_ = trim("completion")
    fenced = r"(?s)\A```(?:json|javascript|js)?\s*\n?(.*?)\n?```\s*\z"
    text = f"CASE WHEN {has(body_, fenced)} THEN {trim(find(body_, fenced))} ELSE {body_} END"
    return f"raw_ AS ({sql}), texts_ AS (SELECT * EXCLUDE (completion), {text} AS c FROM raw_), js_ AS (SELECT * EXCLUDE (c), CASE WHEN json_valid(c) THEN CAST(c AS JSON) END AS j FROM texts_)"


def reason(rules):
    return "CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'not a JSON object' " + " ".join(f"WHEN NOT ({ok}) THEN '{name}'" for ok, name in rules) + " END"


_POS = js("mention_position")
ANALYSES = f"""{loaded(I.ANALYSIS_SQL)}, judged AS (SELECT *, {reason([
    (f"{jtype('brand_mentioned')} = 'BOOLEAN'", 'brand_mentioned'),
    (f"{jtype('mention_position')} = 'NULL' OR coalesce(json_type({_POS}) IN ('UBIGINT', 'BIGINT') AND TRY_CAST({_POS} AS INT) >= 0, false)", 'mention_position'),
    (f"{jtype('mention_context')} IN ('NULL', 'VARCHAR')", 'mention_context'),
    (f"{jtype('brand_citation_present')} = 'BOOLEAN'", 'brand_citation_present'),
    (f"{jtype('sentiment')} = 'NULL' OR coalesce({jstr('sentiment')} IN ('positive', 'neutral', 'negative'), false)", 'sentiment'),
    (text_list('competitors_cited'), 'competitors_cited'), (text_list('sources_cited'), 'sources_cited')])} AS rejected FROM js_),
analyses AS (SELECT response_id, rejected IS NULL AND {jstr('brand_mentioned')} = 'true' AS brand_mentioned,
  CASE WHEN rejected IS NULL THEN TRY_CAST({jstr('mention_position')} AS INT) END AS mention_position,
  rejected IS NULL AND {jstr('brand_citation_present')} = 'true' AS brand_citation_present,
  CASE WHEN rejected IS NULL THEN {jstr('sentiment')} END AS sentiment,
  CASE WHEN rejected IS NULL THEN md5({jstr('mention_context')}) END AS context_md5,
  CASE WHEN rejected IS NULL THEN {as_list('competitors_cited')} ELSE [] END AS comp, rejected FROM judged)"""
RESPONSES = f"""{ANSWERS}, {ANALYSES}, responses AS (SELECT a.*, n.* EXCLUDE (response_id), a.text <> '' AND a.error IS NULL AS analysed FROM answers a JOIN analyses n USING (response_id)),
pointed AS (SELECT *, CASE WHEN NOT (analysed AND brand_mentioned) THEN 0 WHEN mention_position = 1 AND sentiment = 'positive' THEN 100
  WHEN mention_position <= 3 AND sentiment IN ('positive', 'neutral') THEN 75 WHEN sentiment IN ('positive', 'neutral') THEN 50 WHEN sentiment = 'negative' THEN 25 ELSE 50 END AS points FROM responses)"""
VISIBILITY = "vis_p AS (SELECT audit_id, " + ", ".join(
    f"coalesce(CAST(floor(avg(points) FILTER (WHERE provider = '{p}') + 0.5) AS INT), 0) AS {p}" for p in M.PROVIDERS
) + """, coalesce(count(*) FILTER (WHERE analysed AND brand_mentioned) * 100.0 / nullif(count(*) FILTER (WHERE analysed), 0), 0) AS mention_rate,
  coalesce(count(*) FILTER (WHERE analysed AND brand_citation_present) * 100.0 / nullif(count(*) FILTER (WHERE analysed), 0), 0) AS citation_rate FROM pointed GROUP BY audit_id),
vis AS (SELECT *, CAST(floor((openai + anthropic + perplexity + gemini) / 4.0 + 0.5) AS INT) AS visibility_score FROM vis_p)"""
_PRANK = "list_position(['openai', 'anthropic', 'perplexity', 'gemini'], provider)"
RIVALS = f"""named AS (SELECT audit_id, position, {_PRANK} AS rank, unnest(comp) AS raw, generate_subscripts(comp, 1) AS n FROM responses WHERE analysed),
rival_counts AS (SELECT audit_id, {trim('raw')} AS name, count(*) AS count, min(position * 100000 + rank * 1000 + n) AS seen FROM named WHERE {trim('raw')} <> '' GROUP BY audit_id, {trim('raw')}),
rivals AS (SELECT audit_id, row_number() OVER (PARTITION BY audit_id ORDER BY count DESC, seen) AS place, name, count FROM rival_counts QUALIFY place <= 10)"""

EVERY = """every_audit AS (SELECT t.site_id AS audit_id, technical_score, passed_checks, total_checks, coalesce(visibility_score, 0) AS visibility_score,
  coalesce(mention_rate, 0) AS mention_rate, coalesce(citation_rate, 0) AS citation_rate, coalesce(gemini, 0) AS gemini FROM tech t LEFT JOIN vis v ON v.audit_id = t.site_id)"""

QUESTIONS = f"""{loaded(I.QUESTION_JSON_SQL)}, judged AS (SELECT *, {reason([(f"{text_list(c)} AND len(CAST({js(c)} AS JSON[])) = 10", c) for c in ('branded', 'service', 'comparative')])} AS rejected FROM js_),
qlists AS (SELECT audit_id, unnest(list_concat({', '.join(f"list_transform({as_list(c)}, lambda x: {{'category': '{c}', 'text': x}})" for c in ('branded', 'service', 'comparative'))})) AS q,
  unnest(range(1, 31)) AS position FROM judged WHERE rejected IS NULL),
questions AS (SELECT audit_id, CAST(position AS INT) AS position, q.category AS category, q.text AS text FROM qlists)"""

BUSINESS = f"""{loaded(I.BUSINESS_JSON_SQL)}, judged AS (SELECT *, {reason([
    (f"{jtype('brand_name')} = 'VARCHAR'", 'brand_name'), (text_list('brand_aliases'), 'brand_aliases'), (f"{jtype('industry')} IN ('NULL', 'VARCHAR')", 'industry'),
    (text_list('services'), 'services'), (f"{jtype('geo_zone')} IN ('NULL', 'VARCHAR')", 'geo_zone'), (text_list('detected_competitors'), 'detected_competitors'),
    (f"coalesce({jstr('language')} IN ('fr', 'en', 'es', 'de', 'it', 'other'), false)", 'language')])} AS rejected FROM js_),
business AS (SELECT audit_id, domain, CASE WHEN rejected IS NULL THEN {jstr('brand_name')} ELSE domain END AS brand_name,
  {', '.join(f"CASE WHEN rejected IS NULL THEN array_to_string({as_list(c)}, '|') ELSE '' END AS {c}" for c in ('brand_aliases', 'services', 'detected_competitors'))},
  CASE WHEN rejected IS NULL THEN {jstr('industry')} END AS industry, CASE WHEN rejected IS NULL THEN {jstr('geo_zone')} END AS geo_zone,
  CASE WHEN rejected IS NULL THEN {jstr('language')} ELSE 'fr' END AS language, rejected FROM judged)"""

_REC = "CAST(json_extract(j, '$.recommendations') AS JSON[])"
SYNTHESIS = f"""{loaded(I.SYNTHESIS_JSON_SQL)}, judged AS (SELECT *, {reason([
    (f"{jtype('verdict')} = 'VARCHAR'", 'verdict'), (f"{jtype('top_competitor')} IN ('NULL', 'VARCHAR')", 'top_competitor'),
    (f"len({_REC}) BETWEEN 5 AND 15", 'number of recommendations'),
    (f"len(list_filter({_REC}, lambda x: NOT coalesce(json_extract_string(x, '$.priority') IN ('quick_win', 'medium', 'long_term') AND CAST(json_extract(x, '$.impact_score') AS INT) BETWEEN 1 AND 10, false))) = 0", 'recommendation')])} AS rejected FROM js_),
synthesis AS (SELECT audit_id, CASE WHEN rejected IS NULL THEN {jstr('verdict')} END AS verdict, CASE WHEN rejected IS NULL THEN {jstr('top_competitor')} END AS top_competitor,
  CASE WHEN rejected IS NULL THEN {_REC} ELSE [] END AS recs, rejected FROM judged)"""

# -- ledgers -------------------------------------------------------------------------------

_PRICE_ROWS = ", ".join(f"('{p}', '{m}', {a}::DECIMAL(8,4), {b}::DECIMAL(8,4), {f or 0}::DECIMAL(8,4))" for p, m, a, b, f in M.PRICES)
USAGE = f"""prices(provider, model, pin, pout, fee) AS (VALUES {_PRICE_ROWS}), calls AS ({I.USAGE_SQL}),
exact_usd AS (SELECT c.*, p.pin IS NOT NULL AS listed, CASE WHEN actual_cost_usd > 0 THEN CAST(actual_cost_usd AS DECIMAL(28,10))
  WHEN p.pin IS NOT NULL THEN CAST((CAST(tokens_in AS DECIMAL(12,0)) * p.pin + CAST(tokens_out AS DECIMAL(12,0)) * p.pout) * 0.000001 + p.fee AS DECIMAL(28,10)) ELSE CAST(0 AS DECIMAL(28,10)) END AS usd
  FROM calls c LEFT JOIN prices p USING (provider, model)),
usage_ AS (SELECT *, CAST(usd AS DECIMAL(10,6)) AS cost_usd, CAST(usd * 0.92 AS DECIMAL(10,6)) AS cost_eur, actual_cost_usd > 0 OR listed AS priced FROM exact_usd)"""
LEDGER = f"ledger AS ({I.LEDGER_SQL})"


def dbl(x):
    return f"round(CAST({x} AS DOUBLE), 6)"


def crossings(src, caps, month):
    m = "strftime(date_trunc('month', created_at), '%Y-%m') AS month, " if month else ""
    return f"""run AS (SELECT *, sum(cost_eur) OVER (PARTITION BY date_trunc('month', created_at) ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS after_ FROM {src}),
crossed AS (SELECT *, after_ - cost_eur AS before_ FROM run)
SELECT {m}event_id, {dbl('before_')} AS before_eur, {dbl('after_')} AS after_eur, CASE WHEN before_ < {caps.critical} AND after_ >= {caps.critical} THEN 'critical' ELSE 'warning' END AS level
FROM crossed WHERE (before_ < {caps.critical} AND after_ >= {caps.critical}) OR (before_ < {caps.warning} AND after_ >= {caps.warning})"""


def _captures():
    shell_text = trim(sub(sub(sub("html", r"(?is)<script.*?</script>"), r"(?is)<style.*?</style>"), r"<[^>]+>", " "))
    shell = f"(contains(lower(html), '__next_data__') OR {has('html', r'(?i)<div id="root"\s*>\s*</div>')} OR length({shell_text}) < 500)"
    htm, head, bod = find("d.html", r"(?i)(<html[^>]*>)"), find("d.html", r"(?is)(<head.*?</head>)"), find("r.html", r"(?is)(<body.*?</body>)")
    merged = f"'<!DOCTYPE html>' || coalesce(nullif({htm}, ''), '<html>') || coalesce(nullif({head}, ''), '<head></head>') || coalesce(nullif({bod}, ''), '<body></body>') || '</html>'"
    return f"""WITH caps AS ({I.CAPTURE_SQL}), flagged AS (SELECT *, {shell} AS shell FROM caps),
picked AS (SELECT u.url, CASE WHEN d.ok AND NOT d.shell THEN 'd' WHEN r.ok AND length(r.html) > 500 AND d.ok THEN 'm' WHEN r.ok AND length(r.html) > 500 THEN 'r'
   WHEN h.ok THEN 'h' WHEN d.ok THEN 'd' WHEN r.ok THEN 'r' WHEN h.url IS NOT NULL THEN 'h' WHEN d.url IS NOT NULL THEN 'd' ELSE 'r' END AS pick, d, r, h, {merged} AS merged
  FROM (SELECT DISTINCT url FROM caps) u LEFT JOIN (SELECT * FROM flagged WHERE method = 'fetch') d USING (url) LEFT JOIN (SELECT * FROM flagged WHERE method = 'jina') r ON r.url = u.url
  LEFT JOIN (SELECT * FROM flagged WHERE method = 'browserless') h ON h.url = u.url)
SELECT url, CASE pick WHEN 'm' THEN true WHEN 'd' THEN d.ok WHEN 'r' THEN r.ok ELSE h.ok END AS ok, CASE pick WHEN 'h' THEN h.status WHEN 'r' THEN r.status ELSE d.status END AS status,
  CASE pick WHEN 'd' THEN 'fetch' WHEN 'h' THEN 'browserless' ELSE 'jina' END AS method, md5(CASE pick WHEN 'm' THEN merged WHEN 'd' THEN d.html WHEN 'r' THEN r.html ELSE h.html END) AS html_md5,
  CASE pick WHEN 'd' THEN 'fetch' WHEN 'h' THEN 'browserless' ELSE 'jina' END AS via FROM picked"""


def _reply_sql(kind):
    if kind == "chat":
        sql, bad = I.CHAT_SQL, "WHEN coalesce(json_array_length(j, '$.choices'), 0) = 0 THEN 'reply without choices'"
        text, tin, tout = "coalesce(json_extract_string(j, '$.choices[0].message.content'), '')", "$.usage.prompt_tokens", "$.usage.completion_tokens"
        usd = "coalesce(CAST(json_extract_string(j, '$.usage.cost') AS DECIMAL(28,10)), 0)"
        cited = "coalesce(list_transform(CAST(json_extract(j, '$.citations') AS JSON[]), lambda x: json_extract_string(x, '$') || '='), [])"
        noted = "coalesce(list_transform(CAST(json_extract(j, '$.choices[0].message.annotations') AS JSON[]), lambda x: coalesce(json_extract_string(x, '$.url_citation.url'), json_extract_string(x, '$.url')) || '=' || coalesce(json_extract_string(x, '$.url_citation.title'), json_extract_string(x, '$.title'), '')), [])"
        sources = f"array_to_string(list_concat({cited}, {noted}), '|')"
    else:
        sql, bad = I.PARTS_SQL, ""
        text = "array_to_string(list_filter(list_transform(CAST(json_extract(j, '$.candidates[0].content.parts') AS JSON[]), lambda x: json_extract_string(x, '$.text')), lambda x: x <> ''), '')"
        tin, tout = "$.usageMetadata.promptTokenCount", "$.usageMetadata.candidatesTokenCount"
        usd = f"CASE WHEN model = 'google/gemini-2.5-flash' THEN (CAST(json_extract_string(j, '{tin}') AS DECIMAL(12,0)) * 0.3 + CAST(json_extract_string(j, '{tout}') AS DECIMAL(12,0)) * 2.5) * 0.000001 ELSE 0 END"
        sources = "array_to_string(list_transform(list_filter(coalesce(CAST(json_extract(j, '$.candidates[0].groundingMetadata.groundingChunks') AS JSON[]), CAST([] AS JSON[])), lambda x: json_extract_string(x, '$.web.uri') IS NOT NULL), lambda x: json_extract_string(x, '$.web.uri') || '=' || coalesce(json_extract_string(x, '$.web.title'), '')), '|')"
    return f"""raw_r AS ({sql}), parsed_r AS (SELECT *, CASE WHEN json_valid(reply) THEN CAST(reply AS JSON) END AS j FROM raw_r),
errs AS (SELECT *, CASE WHEN status NOT BETWEEN 200 AND 299 THEN 'HTTP ' || status || ': ' || reply WHEN j IS NULL THEN 'reply is not JSON' {bad} END AS error FROM parsed_r),
reply_{kind} AS (SELECT response_id, model, CASE WHEN error IS NULL THEN {text} END AS text, CASE WHEN error IS NULL THEN coalesce(TRY_CAST(json_extract_string(j, '{tin}') AS INT), 0) ELSE 0 END AS tokens_in,
  CASE WHEN error IS NULL THEN coalesce(TRY_CAST(json_extract_string(j, '{tout}') AS INT), 0) ELSE 0 END AS tokens_out, CASE WHEN error IS NULL THEN CAST({usd} AS DOUBLE) ELSE 0 END AS usd,
  CASE WHEN error IS NULL THEN {sources} ELSE '' END AS sources, error FROM errs)"""


def _found(value):
    """Type name of a JSON value."""
    return f"CASE json_type({value}) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'NUMBER' WHEN 'BIGINT' THEN 'NUMBER' WHEN 'DOUBLE' THEN 'NUMBER' ELSE json_type({value}) END"


def _broken(payload, source, fields, items):
    """Rows of all broken rules of the payloads `j` of a query with id: `fields` (path, rule, test of
    k, its type, and x, the value), `items` (path of a list, path below an item, rule, test)."""
    none = "coalesce(k, '')"
    parts = [f"SELECT id, '$' AS path, 'object' AS rule, coalesce({_found('j')}, 'NO JSON') AS found FROM p WHERE coalesce(json_type(j), '') <> 'OBJECT'"]
    whole = "(SELECT * FROM p WHERE json_type(j) = 'OBJECT')"
    for path, rule, ok in fields:
        parts.append(f"SELECT id, '{path}', '{rule}', coalesce(k, 'ABSENT') FROM (SELECT id, x, {_found('x')} AS k FROM (SELECT id, json_extract(j, '{path}') AS x FROM {whole})) WHERE NOT coalesce({ok.replace('kind', none)}, false)")
    for path, below, rule, ok in items:
        listed = f"SELECT id, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS n FROM (SELECT id, json_extract(j, '{path}') AS l FROM {whole}) WHERE json_type(l) = 'ARRAY'"
        parts.append(f"SELECT id, '{path}[' || n || ']{below}', '{rule}', coalesce(k, 'ABSENT') FROM (SELECT *, {_found('x')} AS k FROM (SELECT *, json_extract(l, '$[' || n || ']{below}') AS x FROM ({listed}))) WHERE NOT coalesce({ok.replace('kind', none)}, false)")
    return f"SELECT '{payload}' AS payload, * FROM (WITH p AS ({source}) {' UNION ALL '.join(parts)})"


def _payload_breaches():
    text, text_or_null, listed = "kind = 'STRING'", "kind IN ('STRING', 'NULL')", "kind = 'ARRAY'"
    flag, count = "kind = 'BOOLEAN'", "json_type(x) = 'UBIGINT' OR kind IN ('NULL', '')"
    missing = lambda test: f"({test} OR kind = '')"
    within = lambda *names: "kind = 'STRING' AND json_extract_string(x, '$') IN (" + ", ".join(f"'{n}'" for n in names) + ")"
    texts = lambda *names: [(f"$.{n}", "", "string", text) for n in names]
    rows = lambda sql, key: f"WITH {loaded(sql)} SELECT {key} AS id, j FROM js_"
    ten = "len(CAST(x AS JSON[])) = 10"
    is_count = "whole number from 0 or null or absent"

    def replies(sql):
        return f"WITH r AS ({sql}) SELECT response_id AS id, CASE WHEN json_valid(reply) THEN CAST(reply AS JSON) END AS j FROM r WHERE status BETWEEN 200 AND 299"

    def calls(payload, sql):
        return f"SELECT '{payload}', response_id, 'status', '200 to 299', CAST(status AS VARCHAR) FROM ({sql}) WHERE status NOT BETWEEN 200 AND 299"

    lists = ("branded", "service", "comparative")
    return " UNION ALL ".join([
        _broken("analysis", rows(I.ANALYSIS_SQL, "response_id"), [
            ("$.brand_mentioned", "boolean", flag), ("$.mention_position", "whole number from 0 or null", "json_type(x) = 'UBIGINT' OR kind = 'NULL'"),
            ("$.mention_context", "string or null", text_or_null), ("$.brand_citation_present", "boolean", flag),
            ("$.sentiment", "one of positive, neutral, negative or null", f"kind = 'NULL' OR {within('positive', 'neutral', 'negative')}"),
            ("$.competitors_cited", "list", listed), ("$.sources_cited", "list", listed),
        ], texts("competitors_cited", "sources_cited")),
        _broken("business", rows(I.BUSINESS_JSON_SQL, "audit_id"), [
            ("$.brand_name", "string", text), ("$.brand_aliases", "list", listed), ("$.industry", "string or null", text_or_null), ("$.services", "list", listed),
            ("$.geo_zone", "string or null", text_or_null), ("$.detected_competitors", "list", listed),
            ("$.language", "one of fr, en, es, de, it, other", within("fr", "en", "es", "de", "it", "other")),
        ], texts("brand_aliases", "services", "detected_competitors")),
        _broken("questions", rows(I.QUESTION_JSON_SQL, "audit_id"), [(f"$.{n}", rule, ok) for n in lists for rule, ok in (("list", listed), ("list of 10", ten))], texts(*lists)),
        _broken("synthesis", rows(I.SYNTHESIS_JSON_SQL, "audit_id"), [
            ("$.verdict", "string", text), ("$.top_competitor", "string or null", text_or_null),
            ("$.recommendations", "list of 5 to 15", "len(CAST(x AS JSON[])) BETWEEN 5 AND 15"), ("$.recommendations", "list or absent", missing(listed)),
        ], [
            ("$.recommendations", ".priority", "one of quick_win, medium, long_term", within("quick_win", "medium", "long_term")),
            *[("$.recommendations", f".{n}", "string", text) for n in ("category", "title", "description")],
            ("$.recommendations", ".impact_score", "whole number from 1 to 10", "json_type(x) = 'UBIGINT' AND CAST(x AS INT) BETWEEN 1 AND 10"),
        ]),
        _broken("chat", replies(I.CHAT_SQL), [
            ("$.choices", "list of 1 or more", "len(CAST(x AS JSON[])) > 0"), ("$.choices", "list or absent", missing(listed)), ("$.usage.prompt_tokens", is_count, count),
            ("$.usage.completion_tokens", is_count, count), ("$.usage.cost", "number or null or absent", "kind IN ('NUMBER', 'NULL', '')"), ("$.citations", "list or absent", missing(listed)),
        ], [("$.choices", ".message", "object", "kind = 'OBJECT'"), ("$.choices", ".message.content", "string or null or absent", missing(text_or_null)), *texts("citations")]),
        calls("chat", I.CHAT_SQL),
        _broken("parts", replies(I.PARTS_SQL), [
            ("$.candidates", "list of 1 or more", "len(CAST(x AS JSON[])) > 0"), ("$.candidates[0].content.parts", "list or absent", missing(listed)),
            ("$.usageMetadata.promptTokenCount", is_count, count), ("$.usageMetadata.candidatesTokenCount", is_count, count),
        ], [("$.candidates[0].content.parts", "", "object", "kind = 'OBJECT'"), ("$.candidates[0].content.parts", ".text", "string or null or absent", missing(text_or_null))]),
        calls("parts", I.PARTS_SQL),
    ])


def _reply_select(kind):
    return f"WITH {_reply_sql(kind)} SELECT response_id, model, text, tokens_in, tokens_out, round(usd, 9) AS cost_usd, round(usd * 0.92, 9) AS cost_eur, sources, error FROM reply_{kind}"


_REQ_URL = "CASE WHEN json_type(json_extract(j, '$.url')) = 'VARCHAR' THEN json_extract_string(j, '$.url') END"
REQUESTS = f"""reqs AS ({I.REQUEST_SQL}), preq AS (SELECT request_id, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM reqs),
intake AS (SELECT request_id, {_REQ_URL} AS url, json_extract_string(j, '$.geo_target') AS geo_target,
  CASE WHEN j IS NULL THEN 'invalid JSON body' WHEN NOT coalesce({has(_REQ_URL, IS_URL)}, false) THEN 'url' WHEN coalesce(json_type(json_extract(j, '$.geo_target')), 'NULL') NOT IN ('NULL', 'VARCHAR') THEN 'geo_target' END AS rejected FROM preq)"""

_OWN = f"SELECT id FROM audits WHERE user_id = {K.USER}"
_CHILD = f"audits AS ({I.AUDIT_SQL}), child AS ({I.CHILD_SQL}), resp AS ({I.RESPONSE_SQL}), ana AS ({I.ANALYSIS_ROW_SQL})"


def _stored():
    return ", ".join(f"{name} AS ({sql})" for name, (_, sql) in I.STORED_SQL.items())


def _stored_integrity():
    """Every rule spelled out as a query of its own."""
    allowed = [
        ("profiles", "role", "'admin', 'client'"),
        ("audits", "status", "'queued', 'scraping', 'extracting', 'querying', 'analyzing', 'scoring', 'done', 'failed'"),
        ("audit_technical", "category", "'foundations', 'geo_triptych', 'structured_data', 'content', 'authority'"),
        ("queries", "category", "'branded', 'service', 'comparative'"),
        ("ai_responses", "provider", "'openai', 'anthropic', 'perplexity', 'gemini'"),
        ("ai_response_analysis", "sentiment", "'positive', 'neutral', 'negative'"),
        ("audit_recommendations", "priority", "'quick_win', 'medium', 'long_term'"),
    ]
    ranges = [
        ("audits", "progress", 0, 100), ("audit_technical", "score", 0, 20), ("audit_scores", "technical_score", 0, 100),
        ("audit_scores", "visibility_score", 0, 100), ("audit_scores", "global_score", 0, 100), ("audit_recommendations", "impact_score", 1, 10),
    ]
    parents = [
        ("audits", "user_id", "profiles"), ("audit_business_info", "audit_id", "audits"), ("audit_technical", "audit_id", "audits"),
        ("queries", "audit_id", "audits"), ("ai_responses", "query_id", "queries"), ("ai_response_analysis", "response_id", "ai_responses"),
        ("audit_scores", "audit_id", "audits"), ("audit_recommendations", "audit_id", "audits"), ("api_usage", "user_id", "profiles"),
        ("api_usage", "audit_id", "audits"), ("email_captures", "audit_id", "audits"), ("rate_limits", "audit_id", "audits"),
    ]
    unique = [("profiles", "email"), ("audit_technical", "audit_id, category"), ("ai_responses", "query_id, provider")]
    rows = [f"SELECT '{t}' AS table_name, '{c} not allowed' AS rule, (SELECT count(*) FROM {t} WHERE {c} NOT IN ({v})) AS violations" for t, c, v in allowed]
    rows += [f"SELECT '{t}', '{c} out of range', (SELECT count(*) FROM {t} WHERE {c} IS NULL OR {c} NOT BETWEEN {a} AND {b})" for t, c, a, b in ranges]
    rows += [f"SELECT '{t}', '{c} without parent', (SELECT count(*) FROM {t} x WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.id = x.{c}))" for t, c, p in parents]
    rows += [f"SELECT '{t}', '{k} not unique', (SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {k} HAVING count(*) > 1))" for t, k in unique]
    return f"WITH {_stored()} " + " UNION ALL ".join(rows)


def _euro():
    amount = "CAST(cost_eur * 1000 AS DECIMAL(18,2))"
    return f"translate(format('{{:,.2f}}', CAST({amount} AS DOUBLE)), ',.', ' ,') || ' €'"


_MONTHS = "['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre', 'décembre']"


def statements() -> dict[str, str]:
    sig = f"WITH {SIGNALS} SELECT site_id, "
    by_facts = f"{FACTS} SELECT site_id, "
    out = {
        "url_forms": f"""SELECT page_id, {origin('url')} || {path('url')} AS site_url,
          CASE WHEN {path('url')} = '/' THEN {origin('url')} || {path('url')} || {query('url')} ELSE {normal('url')} END AS page_url, {host('url')} AS domain, {origin('url')} AS origin,
          len({keep("string_split(" + path('url') + ", '/')", "x <> ''")}) AS depth, CASE WHEN starts_with(url, 'https') THEN 'https' ELSE 'http' END AS protocol,
          NOT {has('url', '(?i)[.](?:' + '|'.join(ASSET_SUFFIXES) + ')$')} AS is_page FROM pages""",
        "page_meta": sig + f"""title, description, canonical, viewport, coalesce(lang, {last_of('og', "x.property = 'og:locale'")}) AS language, {last_of('og', "x.property = 'og:site_name'")} AS og_site_name,
          {last_of('og', "x.property = 'og:title'")} AS og_title, len(list_distinct({each('og', 'x.property')})) AS og_count, {last_of('twitter', "x.name = 'twitter:card'")} AS twitter_card,
          array_to_string(list_sort([substr(p, 4) || '=' || list_last([x.content FOR x IN og IF x.property = p]) FOR p IN list_distinct([x.property FOR x IN og])]), '|') AS og_pairs FROM sig""",
        "page_headings": sig + "array_to_string(h1, '|') AS h1, len(h2) AS h2_count, len(h4) AS h4_count, array_to_string(list_concat(h2, h3), '|') AS h2_h3 FROM sig",
        "question_headings": f"WITH {SIGNALS}, hs AS (SELECT site_id, list_concat(list_concat(h1, h2), h3) AS l FROM sig), u AS (SELECT site_id, unnest(l) AS heading, generate_subscripts(l, 1) - 1 AS ord FROM hs) SELECT *, {is_question('heading')} AS is_question FROM u",
        "heading_answers": f"WITH {SIGNALS}, u AS (SELECT site_id, unnest(ah) AS heading, unnest(ap) || unnest(ad) AS answer, generate_subscripts(ah, 1) - 1 AS ord FROM sig) SELECT *, {opens('answer')} AS direct FROM u",
        "image_stats": sig + f"""len(imgs) AS total, len({keep('imgs', has('x', r'(?i)\salt(?:[\s=/>]|\z)'))}) AS with_alt,
          len({keep('imgs', has('x', r'(?i)\salt(?:[\s=/>]|\z)') + ' AND ' + jslen(trim(attr('x', 'alt'))) + ' > 3')}) AS with_meaningful_alt FROM sig""",
        "hreflang_pairs": f"WITH {SIGNALS}, u AS (SELECT site_id, unnest(hreflang) AS p, generate_subscripts(hreflang, 1) - 1 AS ord FROM sig) SELECT site_id, ord, p.lang AS lang, p.href AS href FROM u",
        "page_links": f"WITH {SITE}, {STAGED}, {LINKS} SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY n) - 1 AS ord, link FROM links",
        "link_sample": f"WITH {SITE}, {STAGED}, {LINKS}, {SAMPLE} SELECT site_id, ord, link FROM sample",
        "visible_text": sig + f"md5(vtext) AS text_md5, {words('mtext')} AS words FROM sig",
        "document_readability": f"WITH t AS (SELECT doc_id, {collapse('text')} AS vtext FROM documents) SELECT doc_id, len({_SENT}) AS sentences, {words('vtext')} AS words, {jslen("replace(vtext, ' ', '')")} AS chars FROM t",
        "shell_and_wall": f"WITH {SITE} SELECT site_id, {_SHELL} AS is_shell, {_WALL} AS bot_wall FROM site",
        "brand_names": f"WITH {SIGNALS}, {OBJECTS}, {SCHEMA} SELECT site_id, {_BRAND} AS brand FROM sig LEFT JOIN schema_facts USING (site_id)",
        "jsonld_blocks": f"WITH {SITE}, {STAGED}, {BLOCKS} SELECT site_id, ord, raw, json_valid(raw) AS is_valid FROM blocks",
        "jsonld_objects": f"WITH {SITE}, {STAGED}, {OBJECTS} SELECT * REPLACE (array_to_string(types, '|') AS types) FROM obj",
        "local_businesses": f"WITH {SITE}, {STAGED}, {OBJECTS} SELECT site_id, ord, name FROM obj WHERE {typed(*_LOCAL)}",
        "site_ratings": f"WITH {SITE}, {STAGED}, {OBJECTS}, {SCHEMA} SELECT site_id, best_rating, coalesce(rating_total, 0) AS rating_total FROM site LEFT JOIN schema_facts USING (site_id)",
        "robots_rules": f"WITH {SITE}, {ROBOTS} SELECT site_id, agent, kind, value FROM rules",
        "bot_access": f"WITH {SITE}, {ROBOTS}, {BOTS} SELECT * FROM bots",
        "sitemap_entries": f"WITH {SITE}, {SITEMAP} SELECT site_id, ord, loc, lastmod FROM entries",
        "sitemap_stats": f"WITH {SITE}, {SITEMAP} SELECT * REPLACE (round(sitemap_depth_avg, 6) AS sitemap_depth_avg) FROM maps",
        "sitemap_probes": f"WITH {SITE}, {SITEMAP} SELECT * FROM probes",
        "llms_files": f"WITH {SITE}, {SITEMAP}, {LLMS} SELECT * FROM llms",
        "capture_choice": _captures(),
        "site_resources": f"""WITH r AS ({I.RESOURCE_SQL}), t AS (SELECT *, CASE WHEN status IS NULL OR status IN (404, 410) THEN NULL ELSE content END AS body FROM r)
          SELECT site_id, max(body) FILTER (WHERE kind = 'robots') AS robots_txt, max(status) FILTER (WHERE kind = 'robots') AS robots_status, max(body) FILTER (WHERE kind = 'sitemap') AS sitemap_xml,
          max(status) FILTER (WHERE kind = 'sitemap') AS sitemap_status, max(body) FILTER (WHERE kind = 'llms') AS llms_txt, max(status) FILTER (WHERE kind = 'llms') AS llms_status FROM t GROUP BY site_id""",
        "sampled_pages": f"""WITH p AS ({I.PAGE_FETCH_SQL}) SELECT page_id AS site_id, status, CASE WHEN ok THEN md5(html) END AS html_md5, md_tested,
          CASE WHEN md_tested THEN md_status END AS md_status, CASE WHEN md_tested AND md_status = 200 THEN md_content END AS md_content FROM p""",
        "sampled_page_facts": f"WITH {SITE}, {STAGED}, {LINKS}, {SAMPLE}, {MEASURES}, {SAMPLED} SELECT * REPLACE (round(service_words, 6) AS service_words) FROM sampled_facts",
        "request_intake": f"WITH {REQUESTS} SELECT * FROM intake",
        "accepted_requests": f"WITH {REQUESTS} SELECT request_id, url, geo_target, {origin('url')} || {path('url')} AS url_normalized, {host('url')} AS domain FROM intake WHERE rejected IS NULL",
        "chat_replies": _reply_select("chat"),
        "parts_replies": _reply_select("parts"),
        "answers_by_model": f"""WITH a AS (WITH {_reply_sql('chat')} SELECT * FROM reply_chat), b AS (WITH {_reply_sql('parts')} SELECT * FROM reply_parts), every AS (SELECT * FROM a UNION ALL SELECT * FROM b)
          SELECT CASE WHEN model LIKE 'google/%' THEN 'gemini' ELSE 'perplexity' END AS provider, count(*) AS answers, count(error) AS errors, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, count(*) AS known FROM every GROUP BY 1""",
        "category_scores": f"{ALL_CHECKS}, {CATEGORY} SELECT * FROM cats",
        "technical_scores": f"{ALL_CHECKS}, {CATEGORY} SELECT * FROM tech",
        "failed_checks": f"{ALL_CHECKS} SELECT site_id, least(count(*) FILTER (WHERE status IN ('fail', 'warn')), 10) AS shown, count(*) AS listed, string_agg(check_id || ':' || status || ':' || CAST(points_earned AS INT), ',' ORDER BY check_id) AS outcomes FROM checks GROUP BY site_id",
        "brand_mention_counts": f"WITH {SEARCH} SELECT * FROM mention_counts",
        "encyclopedia_articles": f"WITH {ARTICLES} SELECT * FROM wiki",
        "site_overview": by_facts + f"""{host('url')} AS domain, coalesce(lang, {last_of('og', "x.property = 'og:locale'")}) AS language, sampled,
          array_to_string(list_sort(list_distinct(list_concat([home_method], CASE WHEN coalesce(sampled_methods, '') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(sampled_methods, '|') END))), '|') AS fetch_methods,
          map_text AS has_sitemap, coalesce(robots_txt, '') <> '' AS has_robots, has_llms, {_SHELL} AS is_shell, {_WALL} AS bot_wall FROM f""",
        "exact_mentions": f"WITH {ANSWERS}, {CANDS} SELECT a.response_id, e.at_ AS \"at\", e.matched FROM answers a LEFT JOIN exact e USING (response_id)",
        "fuzzy_mentions": f"WITH {ANSWERS}, {CANDS} SELECT m.response_id, f.matched, f.original FROM missed m LEFT JOIN fuzzy f USING (response_id)",
        "mention_report": f"""WITH {RESPONSES}, {CANDS} SELECT audit_id, CASE WHEN NOT brand_mentioned THEN 'none' WHEN e.response_id IS NOT NULL THEN 'exact' WHEN z.response_id IS NOT NULL THEN 'fuzzy' ELSE 'llm' END AS detection_method,
          count(*) AS answers, count(*) FILTER (WHERE brand_mentioned <> (e.response_id IS NOT NULL OR z.response_id IS NOT NULL)) AS disagreements
          FROM responses r LEFT JOIN exact e USING (response_id) LEFT JOIN fuzzy z USING (response_id) WHERE analysed GROUP BY 1, 2""",
        "rule_analysis": f"""WITH {ANSWERS}, {CANDS}, comp AS (SELECT a.response_id, n.name, n.o, strpos(lower(text), lower(n.name)) AS at_ FROM answers a,
            (VALUES ('Supplier#000000001', 0), ('Supplier#000000007', 1), ('Supplier#000000009', 2)) n(name, o) WHERE strpos(lower(text), lower(n.name)) > 0),
          srcs AS (SELECT a.response_id, a.audit_id, a.text, {each(find_all('text', r'(https?://[^\s<>"' + chr(39) + r')\]]+)'), sub('x', r'[.,;:!?]+$'))} AS s FROM answers a)
          SELECT s.response_id, e.at_ IS NOT NULL AS brand_mentioned, CASE WHEN e.at_ IS NOT NULL THEN (SELECT count(*) FROM comp c WHERE c.response_id = s.response_id AND c.at_ < e.at_) + 1 END AS mention_position,
          CASE WHEN e.at_ IS NOT NULL THEN substr(s.text, greatest(e.at_ - 80, 1), 200) END AS mention_context, {any_of('s.s', "regexp_replace(" + host('x') + ", '^www[.]', '') = b.domain")} AS brand_citation_present,
          coalesce((SELECT string_agg(name, '|' ORDER BY at_, o) FROM comp c WHERE c.response_id = s.response_id), '') AS competitors_cited, array_to_string(s.s, '|') AS sources_cited
          FROM srcs s JOIN brands b USING (audit_id) LEFT JOIN exact e ON e.response_id = s.response_id""",
        "loaded_analyses": f"WITH {ANALYSES} SELECT * EXCLUDE (comp), array_to_string(comp, '|') AS competitors_cited FROM analyses",
        "answer_points": f"WITH {RESPONSES} SELECT response_id, points FROM pointed",
        "visibility_scores": f"WITH {RESPONSES}, {VISIBILITY} SELECT * REPLACE (round(mention_rate, 6) AS mention_rate, round(citation_rate, 6) AS citation_rate) FROM vis",
        "top_competitors": f"WITH {RESPONSES}, {RIVALS} SELECT * FROM rivals",
        "audit_scores": f"""{ALL_CHECKS}, {CATEGORY}, {RESPONSES}, {VISIBILITY}, {RIVALS}, {EVERY} SELECT v.audit_id, technical_score, visibility_score, {rnd('(0.4::DOUBLE * technical_score + 0.6::DOUBLE * visibility_score)')} AS global_score,
          (SELECT name FROM rivals r WHERE r.audit_id = v.audit_id AND place = 1) AS top_competitor, round(mention_rate, 2) AS mention_rate, round(citation_rate, 2) AS citation_rate FROM every_audit v""",
        "global_scores": f"""{ALL_CHECKS}, {CATEGORY}, {RESPONSES}, {VISIBILITY}, {EVERY} SELECT v.audit_id, technical_score, visibility_score, {rnd('(0.4::DOUBLE * technical_score + 0.6::DOUBLE * visibility_score)')} AS global_score FROM every_audit v""",
        "question_list": f"WITH {QUESTIONS} SELECT * FROM questions",
        "rejected_question_lists": f"WITH {QUESTIONS} SELECT audit_id, rejected FROM judged WHERE rejected IS NOT NULL",
        "question_tasks": f"""WITH {QUESTIONS}, p(provider, model) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in M.VISIBILITY_MODELS.items())})
          SELECT audit_id, position, category, CASE WHEN audit_id % 2 = 0 AND NOT contains(lower(text), 'lyon') THEN text || ' (depuis Lyon)' ELSE text END AS prompt, provider, model FROM questions, p""",
        "stored_question_ids": f"WITH {QUESTIONS}, s AS ({I.CHILD_SQL}) SELECT q.audit_id, q.position, category, s.id AS query_id FROM questions q JOIN s USING (audit_id, position)",
        "stored_answer_ids": "SELECT l_orderkey * 10 + l_linenumber AS query_id, 'openai' AS provider, l_orderkey * 10 + l_linenumber AS response_id FROM lineitem a JOIN (SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem) b ON b.k = a.l_orderkey * 10 + a.l_linenumber WHERE l_linenumber % 2 = 0",
        "loaded_business": f"WITH {BUSINESS} SELECT * FROM business",
        "loaded_synthesis": f"""WITH {SYNTHESIS} SELECT audit_id, verdict, top_competitor, rejected,
          array_to_string(list_transform(recs, lambda r: {" || ':' || ".join(f"json_extract_string(r, '$.{c}')" for c in ('priority', 'category', 'title', 'description', 'impact_score'))}), '|') AS recommendations FROM synthesis""",
        "payload_breaches": _payload_breaches(),
        "recommendation_rows": f"""WITH {SYNTHESIS}, u AS (SELECT audit_id, unnest(recs) AS r, generate_subscripts(recs, 1) AS position FROM synthesis)
          SELECT audit_id, position, {', '.join(f"json_extract_string(r, '$.{c}') AS {c}" for c in ('priority', 'category', 'title', 'description'))}, CAST(json_extract_string(r, '$.impact_score') AS INT) AS impact_score FROM u""",
        "synthesis_input": f"""{ALL_CHECKS}, {CATEGORY}, {RESPONSES}, {VISIBILITY}, {RIVALS}, {EVERY}, biz AS (WITH {BUSINESS} SELECT * FROM business),
          shown AS (SELECT site_id, least(count(*) FILTER (WHERE status IN ('fail', 'warn')), 10) AS failed_shown FROM checks GROUP BY site_id)
          SELECT v.audit_id, brand_name, industry, technical_score, passed_checks, total_checks, visibility_score, gemini, round(mention_rate, 6) AS mention_rate,
          coalesce((SELECT string_agg(name, '|' ORDER BY place) FROM rivals r WHERE r.audit_id = v.audit_id AND place <= 5), '') AS top_competitors, failed_shown
          FROM every_audit v JOIN biz b ON b.audit_id = v.audit_id JOIN shown s ON s.site_id = v.audit_id""",
        "audit_records": f"""{ALL_CHECKS}, {CATEGORY}, {RESPONSES}, {VISIBILITY}, qn AS (WITH {QUESTIONS} SELECT audit_id, count(*) AS n FROM questions GROUP BY 1), sy AS (WITH {SYNTHESIS} SELECT * FROM synthesis)
          SELECT p.page_id AS audit_id, p.url, technical_score, visibility_score, total_checks AS checks, coalesce(qn.n, 0) AS queries, coalesce(len(sy.recs), 0) AS recommendations, sy.verdict
          FROM pages p JOIN tech t ON t.site_id = p.page_id LEFT JOIN vis v ON v.audit_id = p.page_id LEFT JOIN qn ON qn.audit_id = p.page_id LEFT JOIN sy ON sy.audit_id = p.page_id""",
        "call_costs": f"WITH {USAGE} SELECT event_id, {dbl('cost_usd')} AS cost_usd, {dbl('cost_eur')} AS cost_eur, priced FROM usage_",
        "unpriced_models": f"WITH {USAGE} SELECT provider, model, count(*) AS calls FROM exact_usd WHERE actual_cost_usd <= 0 AND NOT listed GROUP BY 1, 2",
        "month_to_date": f"WITH {USAGE} SELECT '2024-01' AS month, {dbl('sum(cost_eur)')} AS total_eur FROM usage_ WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00' AND created_at <= TIMESTAMP '2024-01-20 12:00:00'",
        "budget_status": f"""WITH {LEDGER}, t AS (SELECT date_trunc('month', created_at) AS m, sum(cost_eur) AS s FROM ledger GROUP BY 1) SELECT strftime(m, '%Y-%m') AS month, {dbl('s')} AS total_eur,
          {dbl(f'greatest(0, {K.CAPS_ORDERS.cap} - s)')} AS remaining_eur, CASE WHEN s >= {K.CAPS_ORDERS.cap} THEN 'blocked' WHEN s >= {K.CAPS_ORDERS.critical} THEN 'critical' WHEN s >= {K.CAPS_ORDERS.warning} THEN 'warning' ELSE 'ok' END AS alert_level,
          s + 1.30 <= {K.CAPS_ORDERS.cap} AS can_run_audit FROM t""",
        "request_admission": f"""WITH {LEDGER}, t AS (SELECT date_trunc('month', created_at) AS m, created_at, sum(sum(cost_eur)) OVER (PARTITION BY date_trunc('month', created_at) ORDER BY created_at) AS s FROM ledger GROUP BY 1, 2),
          r AS (SELECT o_orderkey AS request_id, o_orderdate AS at_, date_trunc('month', o_orderdate) AS m, row_number() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
          SELECT request_id, coalesce(s, 0) + n * 1.30 <= {K.CAPS_ORDERS.cap} AS admitted FROM r ASOF LEFT JOIN t ON r.m = t.m AND r.at_ > t.created_at""",
        "threshold_crossings": f"WITH {LEDGER}, {crossings('ledger', K.CAPS_ORDERS, True)}",
        "usage_crossings": f"WITH {USAGE}, {crossings('usage_', K.CAPS_EVENTS, False)}",
        "audit_costs": f"""WITH {USAGE} SELECT audit_id, {', '.join(f"{dbl(f"coalesce(sum(cost_eur) FILTER (WHERE request_type = {q(t)}), 0)")} AS {t}_eur" for t in ('brand_extraction', 'queries_generation', 'visibility_query', 'mention_analysis', 'synthesis'))},
          {dbl('sum(cost_eur)')} AS total_eur, count(*) AS calls FROM usage_ GROUP BY audit_id""",
        "cost_anomalies": f"WITH {USAGE} SELECT audit_id, {dbl('sum(cost_eur)')} AS total_eur FROM usage_ GROUP BY audit_id HAVING sum(cost_eur) > 3.9",
        "monthly_rollup": f"""WITH {LEDGER} SELECT user_id, strftime(date_trunc('month', created_at), '%Y-%m') AS month, count(*) AS call_count, CAST(sum(tokens_in) AS BIGINT) AS total_tokens_in, CAST(sum(tokens_out) AS BIGINT) AS total_tokens_out,
          {dbl('sum(cost_usd)')} AS total_cost_usd, {dbl('sum(cost_eur)')} AS total_cost_eur FROM ledger WHERE user_id IS NOT NULL GROUP BY 1, 2""",
        "ledger_display": f"WITH {LEDGER} SELECT event_id, {_euro()} AS amount, day(created_at) || ' ' || ({_MONTHS})[month(created_at)] || ' ' || year(created_at) AS day FROM ledger",
        "rate_limit_now": f"""SELECT user_id AS ip, event_type AS action, count(*) AS hits, count(*) >= 2 AS limited FROM events
          WHERE ts > TIMESTAMP '{K.NOW_EVENTS.replace('T', ' ')}' - INTERVAL 1 DAY AND ts <= TIMESTAMP '{K.NOW_EVENTS.replace('T', ' ')}' GROUP BY 1, 2""",
        "rate_limit_history": """WITH e AS (SELECT user_id AS ip, event_type AS action, epoch_us(ts) AS us FROM events),
          w AS (SELECT *, count(*) OVER (PARTITION BY ip, action ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS hits FROM e)
          SELECT ip, action, us AS created_at, count(*) AS new_hits, any_value(hits) AS hits, any_value(hits) >= 2 AS limited FROM w GROUP BY ip, action, us""",
        "owned_questions": f"WITH {_CHILD} SELECT * FROM child WHERE audit_id IN ({_OWN})",
        "owned_answers": f"WITH {_CHILD} SELECT * FROM resp WHERE EXISTS (SELECT 1 FROM child c WHERE c.id = resp.query_id AND c.audit_id IN ({_OWN}))",
        "owned_analyses": f"WITH {_CHILD} SELECT * FROM ana WHERE EXISTS (SELECT 1 FROM resp r JOIN child c ON c.id = r.query_id WHERE r.id = ana.response_id AND c.audit_id IN ({_OWN}))",
        "integrity_report": """SELECT 'duplicate question position' AS rule, count(*) AS violations FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
          UNION ALL SELECT 'score out of range', count(*) FROM lineitem WHERE l_quantity IS NULL OR l_quantity NOT BETWEEN 1 AND 45
          UNION ALL SELECT 'unknown status', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
          UNION ALL SELECT 'audit without owner', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""",
        "table_rules": """SELECT 'audits' AS table_name, 'status not allowed' AS rule, count(*) FILTER (WHERE event_type NOT IN ('queued', 'scraping', 'extracting', 'querying', 'analyzing', 'scoring', 'done', 'failed')) AS violations FROM events
          UNION ALL SELECT 'audits', 'progress out of range', count(*) FILTER (WHERE floor(value) IS NULL OR floor(value) NOT BETWEEN 0 AND 100) FROM events
          UNION ALL SELECT 'ai_responses', 'provider not allowed', count(*) FILTER (WHERE l_linenumber >= 3) FROM lineitem
          UNION ALL SELECT 'ai_responses', 'query_id, provider not unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, CASE WHEN l_linenumber < 3 THEN 'openai' ELSE lower(l_returnflag) END HAVING count(*) > 1)""",
        "stored_integrity": _stored_integrity(),
        "written_tables": f"""WITH {USAGE}, {_stored()}
          SELECT 'audits' AS table_name, 'earlier' AS part, count(*) AS n_rows, sum(id)::BIGINT AS ids FROM audits
          UNION ALL SELECT 'audits', 'load', count(*), sum(id)::BIGINT FROM audits
          {" ".join(f"UNION ALL SELECT '{name}', 'load', count(*), sum({key})::BIGINT FROM {name}" for name, key in (("queries", "id"), ("ai_responses", "id"), ("audit_recommendations", "id"), ("ai_response_analysis", "response_id"), ("audit_business_info", "audit_id"), ("audit_technical", "audit_id"), ("audit_scores", "audit_id")))}
          UNION ALL SELECT 'api_usage', strftime(created_at, '%Y-%m'), count(*), sum(event_id)::BIGINT FROM usage_ GROUP BY strftime(created_at, '%Y-%m')""",
        "exported_records": f"""SELECT strftime(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 2 HOUR * page_id, '%Y-%m-%d') AS day, replace({host('url')}, '.', '_') AS domain,
          count(*) AS n_records, sum(length(html))::BIGINT AS html_chars FROM pages GROUP BY 1, 2""",
        "exported_audits": f"""{ALL_CHECKS}, {CATEGORY}, {RESPONSES}, {VISIBILITY}, qn AS (WITH {QUESTIONS} SELECT audit_id, string_agg(position || ':' || category || ':' || text, '|' ORDER BY position) AS said FROM questions GROUP BY 1),
          sy AS (WITH {SYNTHESIS}, u AS (SELECT audit_id, unnest(recs) AS r, generate_subscripts(recs, 1) AS position FROM synthesis)
            SELECT audit_id, string_agg(json_extract_string(r, '$.priority') || ':' || json_extract_string(r, '$.title') || ':' || json_extract_string(r, '$.impact_score'), '|' ORDER BY position) AS said FROM u GROUP BY 1),
          said AS (SELECT site_id, string_agg(check_id || ':' || status || ':' || CAST(points_earned AS INT), '|' ORDER BY check_id) AS said FROM checks GROUP BY site_id)
          SELECT p.page_id AS audit_id, p.url, strftime(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 2 HOUR * p.page_id, '%Y-%m-%d') AS day, replace({host('p.url')}, '.', '_') AS domain, technical_score, visibility_score,
            said.said AS checks, md5(coalesce(qn.said, '')) AS queries_md5, coalesce(sy.said, '') AS recommendations
          FROM pages p JOIN tech t ON t.site_id = p.page_id JOIN said ON said.site_id = p.page_id LEFT JOIN vis v ON v.audit_id = p.page_id LEFT JOIN qn ON qn.audit_id = p.page_id LEFT JOIN sy ON sy.audit_id = p.page_id""",
        "audit_states": f"""WITH s AS ({I.STATE_SQL}), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY event_ts DESC, seq DESC) = 1)
          SELECT audit_id, status, CASE WHEN status = 'done' THEN 100 ELSE progress END AS progress, current_step, CASE WHEN status = 'failed' THEN error_message END AS error_message, language,
          CASE WHEN status IN ('done', 'failed') THEN epoch_us(event_ts) END AS completed_at, epoch_us(event_ts) AS updated_at FROM l""",
        "stream_spend_alerts": f"WITH {USAGE}, {crossings('usage_', K.CAPS_EVENTS, False)}",
        "stream_rate_windows": """WITH e AS (SELECT user_id AS ip, event_type AS action, epoch_us(ts) // 1000000 AS s FROM events), w AS (SELECT ip, action, (s // 1800) * 1800 + unnest([1800, 3600]) AS window_end FROM e)
          SELECT ip, action, window_end, count(*) AS hits FROM w GROUP BY 1, 2, 3""",
        "stream_visibility": f"WITH {RESPONSES}, {VISIBILITY} SELECT * REPLACE (round(mention_rate, 6) AS mention_rate, round(citation_rate, 6) AS citation_rate) FROM vis",
        "stream_admission": f"""WITH {USAGE}, t AS (SELECT date_trunc('month', created_at) AS m, sum(cost_eur) AS spent FROM usage_ GROUP BY 1), {REQUESTS}, a AS (SELECT request_id, geo_target, {origin('url')} || {path('url')} AS url_normalized, date_trunc('month', TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * request_id) AS m FROM intake WHERE rejected IS NULL)
          SELECT request_id, geo_target, url_normalized, coalesce(spent, 0) + row_number() OVER (PARTITION BY m ORDER BY request_id) * 1.30 <= 60 AS admitted FROM a LEFT JOIN t USING (m)""",
    }
    for name, cat in (("foundations_checks", "foundations"), ("geo_checks", "geo_triptych"), ("structured_checks", "structured_data"), ("content_checks", "content"), ("authority_checks", "authority")):
        out[name] = f"{FACTS}, {check_rows(cat)} SELECT * FROM checks"
    return out
