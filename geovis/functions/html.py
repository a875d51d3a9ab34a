"""HTML functions on whole documents: patterns over Columns, and a fold over tags for what nests.

Pages may be cut off, so every closing tag may also be the end of the text. No pattern may look at
the rest of a page again and again: what opens something also accepts the end of the text as its
end, and a pattern whose end must be there is only used before the last such end.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from geovis.functions.core import let, part, running
from geovis.functions import text as T
from geovis.functions.text import collapse_space, holds_any, js_trim

# What stands between a tag's name and its end. A quote opens a value only right after `=`.
# Possessive repetition: Java runs it as a loop, where a plain repeated group would recurse once
# for every attribute.
_ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TAG = rf"""</?[A-Za-z!]{_ATTRS}(?:>|\z)"""

# Elements whose tags end a paragraph.
_BLOCKS = (
    "address|article|aside|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|"
    "form|h1|h2|h3|h4|h5|h6|header|hgroup|hr|html|li|listing|main|menu|nav|ol|p|pre|search|section|summary|table|tbody|td|tfoot|th|thead|tr|ul"
)
# A block, paragraph or heading tag with all that follows up to the next such tag. Other tags are
# passed over whole, so that a bracket in a quoted value begins nothing.
_OUTLINE = r"(?:/?div|p|h[1-6])(?=[\s/>])"
PIECE = rf"(?is)(<{_OUTLINE}{_ATTRS}(?:>|\z)(?:[^<]++|<(?!{_OUTLINE})(?:/?[A-Za-z!]{_ATTRS}(?:>|\z))?+)*+)"

# Named character references, as the standard library lists them. References of
# running text come first, because a map is searched from its start.
_COMMON = [
    "lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "middot", "bull", "ndash",
    "mdash", "laquo", "raquo", "lsquo", "rsquo", "ldquo", "rdquo", "hellip", "euro", "deg",
    "times", "eacute", "egrave", "ecirc", "agrave", "acirc", "ccedil", "ocirc", "ugrave", "icirc",
    "amp", "uuml", "ouml", "auml", "szlig", "ntilde",
]
ENTITIES = {f"&{name};": html5[f"{name};"] for name in _COMMON} | {
    f"&{name}": char for name, char in sorted(html5.items()) if name.endswith(";") and name[:-1] not in _COMMON
}
# Numbers that stand for a Windows-1252 character, from 128 on (0: itself).
_WINDOWS = [
    0x20AC, 0, 0x201A, 0x0192, 0x201E, 0x2026, 0x2020, 0x2021, 0x02C6, 0x2030, 0x0160, 0x2039, 0x0152, 0, 0x017D, 0,
    0, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2013, 0x2014, 0x02DC, 0x2122, 0x0161, 0x203A, 0x0153, 0, 0x017E, 0x0178,
]
REFERENCE = r"&(?:[A-Za-z][A-Za-z0-9]*+;|#[0-9]++;?|#[xX][0-9A-Fa-f]++;?)"
UNKNOWN_CHARACTER = "\ufffd"
# References that may give white space: all numbers, and the names of white space.
SPACE_REFERENCE = "&(?:#|" + "|".join(name[1:] for name, char in ENTITIES.items() if set(char) & set(T.WS_CHARS)) + ")"

# Marks of pages that hide behind a bot wall, most specific first, each with words that
# its pattern cannot match without.
BOT_WALLS = [
    ("Vercel Security Checkpoint", r"(?i)vercel security checkpoint", "vercel security checkpoint"),
    ("Cloudflare challenge", r"(?i)just a moment\.{3}", "just a moment..."),
    ("Cloudflare browser verification", r"(?i)cf-browser-verification", "cf-browser-verification"),
    ("Cloudflare attention required", r"(?i)attention required! \| cloudflare", "attention required! | cloudflare"),
    ("Akamai access denied", r"(?is)access denied.{0,200}akamai", "access denied"),
    ("Generic JS challenge", r"(?i)please enable javascript and cookies to continue", "please enable javascript"),
]
SHELL_MIN_TEXT = 500
# Characters behind the last script in which most pages show that they hold enough text.
SHELL_FIRST_LOOK = 2000


def _numbered(ref: Column) -> Column:
    """Character of a numeric reference. Numbers that are no character (zero, surrogates, beyond
    Unicode) give the replacement character."""
    digits = F.regexp_extract(ref, r"^&#[xX]?0*+([0-9A-Fa-f]*+);?$", 1)
    is_hex = ref.rlike(r"^&#[xX]")
    short = F.when(F.length(digits).between(1, 7), digits).otherwise("0")
    number = F.when(is_hex, F.conv(short, 16, 10).cast("int")).otherwise(short.try_cast("int"))
    windows = F.array(*[F.lit(c) for c in _WINDOWS])

    def char(n):
        listed = F.when(n.between(128, 159), F.nullif(F.get(windows, n - 128), F.lit(0)))
        code = F.coalesce(listed, n)
        fine = ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n <= 0x10FFFF))
        return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(UNKNOWN_CHARACTER)

    return let(number, char)


def decode_entities(text: Column) -> Column:
    """Resolve named and numeric character references, in one pass over the text between them, so
    that what a reference yields is never read as one again."""
    listed = "\x01".join(f"{name}\x02{char}" for name, char in ENTITIES.items())
    known = F.str_to_map(F.lit(listed), F.lit("\x01"), F.lit("\x02"))

    def char(ref):
        return F.when(ref.startswith("&#"), _numbered(ref)).otherwise(F.coalesce(F.try_element_at(known, ref), ref))

    def piece(p, i):
        """What stands from one `&` up to the next; a reference never goes past it."""
        whole = F.concat(F.lit("&"), p)

        def replaced(ref):
            return F.when(ref == "", whole).otherwise(F.concat(char(ref), F.substring(whole, F.length(ref) + 1, F.length(whole))))

        return F.when(i == 0, p).otherwise(let(F.regexp_extract(whole, rf"\A{REFERENCE}", 0), replaced))

    def resolve(t):
        return F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "&", -1), piece), "")).otherwise(t)

    return let(text, resolve)


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")


def drop_elements(html: Column, *names: str) -> Column:
    """Remove elements with their content, in one pass for all names."""
    return F.regexp_replace(
        html, rf"(?is)<({'|'.join(names)})\b[^>]*+(?:>.*?(?:</\1\s*+>|\z)|\z)", ""
    )


def _open_end(html: Column) -> Column:
    """What stands behind the last `>`. No tag ends there, so no pattern has to look."""
    return F.substring_index(html, ">", -1)


def before_last(text: Column, end: str) -> Column:
    """The text up to the last match of the pattern `end`, which no match of a pattern that closes
    with it can pass; found from the back."""
    return F.regexp_extract(text, rf"(?is)\A.*(?:{end})", 0)


def strip_tags(html: Column) -> Column:
    def strip(h):
        closed = h.substr(F.lit(1), F.length(h) - F.length(_open_end(h)))
        return F.concat(F.regexp_replace(closed, TAG, ""), _open_end(h))

    return let(html, strip)


def head_part(markup: Column) -> Column:
    return F.regexp_extract(markup, r"(?is)\A(.*?)(?:</head\s*>|<body\b|\z)", 1)


def body_part(markup: Column) -> Column:
    """Everything from the body tag on; without one, everything outside the head."""
    has_body = markup.rlike(r"(?i)<body\b")
    return F.when(has_body, F.regexp_replace(markup, r"(?is)\A.*?<body\b[^>]*+(?:>|\z)", "")).otherwise(
        F.regexp_replace(markup, r"(?is)<head\b.*?(?:</head\s*+>|\z)", "")
    )


def headings(markup: Column) -> Column:
    """array(struct(level, text)) of all headings of level 1 to 4 in page order, found in one
    pass; blank ones dropped. A heading ends where any heading ends or begins."""
    found = F.regexp_extract_all(
        markup, F.lit(r"(?is)(<h[1-4]\b[^>]*+(?:\z|>.*?(?:</h[1-6]\s*+>|(?=<h[1-6]\b)|\z)))"), 1
    )
    texts = F.transform(
        F.filter(found, lambda h: F.contains(h, F.lit(">"))),
        lambda h: F.struct(
            h.substr(3, 1).cast("int").alias("level"), js_trim(decode_entities(strip_tags(h))).alias("text")
        ),
    )
    return F.filter(texts, lambda h: h.text != "")


def _inner_text(markup: Column) -> Column:
    return js_trim(decode_entities(F.regexp_replace(markup, TAG, "")))


def _tag_states(pieces: Column) -> Column:
    """The state after every piece: depth of nested blocks, and place of the second or third level
    heading that is open (-1: none)."""

    def step(state, piece):
        depth = F.greatest(state.depth + piece.nests, F.lit(0))
        heading = F.when(piece.ends | (piece.heading > 0), F.when(~piece.ends & piece.heading.isin(2, 3), piece.place).otherwise(-1)).otherwise(state.heading)
        return F.struct(depth.alias("depth"), heading.alias("heading"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("heading"))
    return running(pieces, start, step)


def _next_of(items: Column, same: str) -> Column:
    """Each item of a sorted array with the one behind it, null where that has another `same`."""

    def pair(found):
        behind = F.slice(found, F.lit(2), F.greatest(F.size(found), F.lit(1)))
        return F.zip_with(found, behind, lambda a, b: F.struct(a.alias("item"), F.when(a[same] == b[same], b).alias("next")))

    return let(items, pair)


def heading_blocks(markup: Column) -> Column:
    """array(struct(heading, answer)) of second and third level headings in page order; the answer
    is the text of the paragraph or block that is the next element, "" when it is another one. Loose
    text before that element is no part of it.

    The tags of blocks, paragraphs and headings are read in one pass. A fold over them keeps the
    depth of nested blocks; sorted by depth and place, a block's opening tag stands right before its
    closing tag, so every block is matched without looking for its end.
    """
    heading_end = r"(?is)</h[1-6]\s*+>"

    def kind(text, place):
        start = F.lower(F.substring(text, 1, 3))
        nests = F.when(start == "<di", 1).when(start == "</d", -1).otherwise(0)
        heading = F.when(start.startswith("<h"), F.substring(start, 3, 1).cast("int")).otherwise(0)
        return F.struct(text.alias("text"), place.alias("place"), nests.alias("nests"), heading.alias("heading"), text.rlike(heading_end).alias("ends"))

    def match(page):
        pieces, states = page.pieces, page.states
        size = F.size(pieces)

        def mark(state, i):
            nests = F.get(pieces, i).nests
            before = F.when(i > 0, F.get(states, i - 1).depth).otherwise(0)
            level = F.when(nests > 0, state.depth).when((nests < 0) & (before > 0), before)
            return F.struct(level.alias("depth"), i.alias("place"), (nests > 0).alias("opens"))

        marks = F.array_sort(F.filter(F.transform(states, mark), lambda m: m.depth.isNotNull()))
        blocks = F.filter(_next_of(marks, "depth"), lambda m: m.item.opens)
        ends = F.transform(blocks, lambda m: F.struct(m.item.place.alias("place"), F.coalesce(m.next.place, size).alias("end")))
        none = F.transform(pieces, lambda p: F.struct(p.place.alias("place"), F.lit(0).alias("end")))
        # One entry per place, the end of its block or 0.
        best = F.filter(_next_of(F.array_sort(F.concat(none, ends)), "place"), lambda e: e.next.isNull())
        block_end = F.transform(best, lambda e: e.item.end)

        def opened(p, i):
            before = F.when(i > 0, F.get(states, i - 1).heading).otherwise(-1)
            return F.when(p.heading.isin(2, 3), i).when(p.ends, before).otherwise(-1)

        # Places of headings, each followed by the place of its end if that is a later one.
        touched = F.transform(pieces, lambda p, i: F.struct(opened(p, i).alias("heading"), i.alias("place")))
        pairs = _next_of(F.array_sort(F.filter(touched, lambda t: t.heading >= 0)), "heading")
        firsts = F.filter(pairs, lambda t: t.item.heading == t.item.place)
        return let(block_end, lambda ends: F.transform(firsts, lambda t: read(pieces, ends, t.item.place, t.next.place)))

    def read(pieces, block_end, place, later):
        end = F.coalesce(later, place)
        text = lambda a, b: F.array_join(F.transform(part(pieces, a, b), lambda p: p.text), "")
        span = text(place, end + 1)
        heading = F.regexp_extract(span, r"(?is)\A(.*?)(?:</h[1-6]\s*+>|\z)", 1)
        behind = F.get(pieces, end + 1).text
        paragraph = F.regexp_extract(behind, rf"(?is)\A<p{_ATTRS}>(.*?)(?:</?(?:{_BLOCKS})(?=[\s/>])|\z)", 1)
        block = text(end + 1, F.get(block_end, end + 1))
        follows = F.get(pieces, end).text.rlike(rf"{heading_end}[^<]*+\z")
        start = F.lower(F.substring(behind, 1, 2))
        answer = F.when(follows & (start == "<p"), _inner_text(paragraph)).when(follows & (start == "<d"), _inner_text(block))
        return F.struct(_inner_text(heading).alias("heading"), F.coalesce(answer, F.lit("")).alias("answer"))

    found = F.transform(F.regexp_extract_all(markup, F.lit(PIECE), 1), kind)
    return let(found, lambda p: let(F.struct(p.alias("pieces"), _tag_states(p).alias("states")), match))


def tags(markup: Column, *names: str) -> Column:
    """All opening tags of the given names in page order."""
    pattern = rf"(?i)(<(?:{'|'.join(names)})\b{_ATTRS}(?:>|\z))"
    closed = let(markup, lambda m: m.substr(F.lit(1), F.length(m) - F.length(_open_end(m))))
    return F.filter(F.regexp_extract_all(closed, F.lit(pattern), 1), lambda t: t.endswith(">"))


def named(tag_list: Column, name: str) -> Column:
    """The tags of one name."""
    return F.filter(tag_list, lambda t: t.rlike(rf"(?i)^<{name}\b"))


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?i)\s{name}(?:[\s=/>]|\z)")


def raw_attr(tag: Column, name: str) -> Column:
    """Attribute value as written, "" when the attribute is missing or empty."""
    raw = F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1$""", "$2")


def attr(tag: Column, name: str) -> Column:
    """Decoded attribute value."""
    return decode_entities(raw_attr(tag, name))


def first_title(head: Column) -> Column:
    """Text of the first title element, null when missing or blank."""
    raw = F.regexp_extract(head, r"(?is)<title\b[^>]*+(?:\z|>(.*?)(?:</title\s*+>|\z))", 1)
    return F.nullif(js_trim(decode_entities(raw)), F.lit(""))


def visible_text(html: Column) -> Column:
    """Body text without scripts, styles and drawings, white space collapsed."""
    markup = drop_elements(strip_comments(html), "script", "style", "noscript", "svg")
    return collapse_space(decode_entities(strip_tags(body_part(markup))))


def main_text(html: Column) -> Column:
    """Body text that also leaves out navigation, header and footer."""
    markup = drop_elements(
        drop_elements(strip_comments(html), "script", "style", "noscript"), "nav", "header", "footer"
    )
    return collapse_space(decode_entities(strip_tags(body_part(markup))))


def count_words(markup: Column) -> Column:
    """Number of words of a markup's text. References are resolved only where they may part words."""
    resolved = let(strip_tags(markup), lambda t: F.when(t.rlike(SPACE_REFERENCE), decode_entities(t)).otherwise(t))
    return T.count_words(collapse_space(resolved))


def is_shell(html: Column) -> Column:
    """True for pages whose content is built in the browser: little or no text in the document.
    Its patterns are fixed values."""

    def without(text, pattern, end, instead):
        parts = let(before_last(text, end), lambda p: F.struct(p.alias("head"), F.substring(text, F.length(p) + 1, F.length(text)).alias("tail")))
        return let(parts, lambda p: F.concat(F.regexp_replace(p["head"], pattern, instead), p["tail"]))

    def looked(tail):
        """Text of whole tags right behind the last script and style. Nothing of it is taken away with
        these, and no tag reaches into it, so the page's whole text holds it."""
        first = F.substring(tail, F.instr(tail, ">") + 1, F.lit(SHELL_FIRST_LOOK))
        whole = let(first, lambda f: F.substring(f, F.lit(1), F.length(f) - F.length(_open_end(f))))
        ended = holds_any(F.lower(tail), ["</script>", "</style>"])
        return F.when(~ended & F.contains(tail, F.lit(">")), F.length(js_trim(F.regexp_replace(whole, r"<[^>]+>", " ")))).otherwise(0)

    def size(h):
        markup = without(h, r"(?is)<script.*?</script>", "</script>", "")
        markup = let(markup, lambda m: without(m, r"(?is)<style.*?</style>", "</style>", ""))
        return F.length(js_trim(let(markup, lambda m: without(m, r"<[^>]+>", ">", " "))))

    tail = F.substring_index(F.substring_index(html, "</script>", -1), "</style>", -1)
    marked = lambda low: (
        F.contains(low, F.lit("__next_data__"))
        | (F.contains(low, F.lit('<div id="root"')) & html.rlike(r'(?i)<div id="root"\s*>\s*</div>'))
        | (F.contains(low, F.lit('<div id="__nuxt"')) & html.rlike(r'(?i)<div id="__nuxt"\s*>\s*</div>'))
    )
    enough = let(tail, looked) >= SHELL_MIN_TEXT
    return F.coalesce(
        (html == "") | let(F.lower(html), marked) | F.when(enough, F.lit(False)).otherwise(size(html) < SHELL_MIN_TEXT),
        F.lit(True),
    )


def bot_wall(html: Column, title: Column, low: Column | None = None) -> Column:
    """Name of the bot wall a page shows, null for none. `low`: the page in lower case, where it is
    there already."""
    title = F.coalesce(title, F.lit(""))

    def named(low):
        shown = lambda pattern, words: (F.contains(low, F.lit(words)) & html.rlike(pattern)) | title.rlike(pattern)
        return F.coalesce(*[F.when(shown(pattern, words), name) for name, pattern, words in BOT_WALLS])

    return let(F.lower(html), named) if low is None else named(low)


def merge_head_body(direct: Column, rendered: Column) -> Column:
    """Head of the directly fetched page with the body of the rendered one. Its patterns are
    fixed values."""

    def part(html, pattern, end, fallback):
        found = F.regexp_extract(before_last(html, end), pattern, 0)
        return F.when(found == "", F.lit(fallback)).otherwise(found)

    return F.concat(
        F.lit("<!DOCTYPE html>"),
        part(direct, r"(?i)<html[^>]*>", ">", "<html>"),
        part(direct, r"(?is)<head.*?</head>", "</head>", "<head></head>"),
        part(rendered, r"(?is)<body.*?</body>", "</body>", "<body></body>"),
        F.lit("</html>"),
    )
