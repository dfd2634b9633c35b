"""Text nodes, titles and links of a page, taken from its tokens.

Pages stay in the JVM: each function is a Column over the raw markup. Comments,
scripts and styles go first; the rest is cut into tags and text, and one fold
carries the open elements along, so the depth of nesting does not matter. An
element's *direct* text is what stands in it and in no child element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from intelweave.functions.flow import bind
from intelweave.functions.text import strip_ws

# Stands where a tag or comment interrupted a text node.
_SEP = "\x01"
_NOISE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!?][^>]*>"
# A tag whose quoted values may hold ">"; with a quote left open, up to the next ">".
_TAG = r"(?:</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^>]*>)"
_TOKEN = rf"(?s){_TAG}|[^<]+|<"
_ATTRIBUTE = r"""(?s)[^\s=>"'/]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
_VOID = "area base br col embed hr img input link meta param source track wbr".split()
# Fixed values of HTML's implied end tags: what a start tag closes, as the tail of the open elements.
_BLOCKS = ("p div ul ol dl table h1 h2 h3 h4 h5 h6 article section main header footer nav aside form blockquote pre address fieldset "
           "center hr").split()
_IMPLIED = [
    (_BLOCKS, "/p", r"/p(?:/(?!p(?:/|$))[^/]+)*$"),
    (["li"], "/li", r"/li(?:/(?!(?:ul|ol|li)(?:/|$))[^/]+)*$"),
    (["dd", "dt"], "/d", r"/d[td](?:/(?!(?:dl|d[td])(?:/|$))[^/]+)*$"),
    (["td", "th"], "/t", r"/t[dh](?:/(?!(?:table|t[rdh])(?:/|$))[^/]+)*$"),
    (["tr"], "/tr", r"/tr(?:/(?!(?:table|tr)(?:/|$))[^/]+)*$"),
    (["tbody", "thead", "tfoot"], "/t", r"/t(?:body|head|foot)(?:/(?!(?:table|t(?:body|head|foot))(?:/|$))[^/]+)*$"),
]


def _numeric(t: Column) -> Column:
    """Decode ``&#8217;`` and ``&#x27;``; what names no character becomes U+FFFD."""
    def char(code: Column) -> Column:
        ok = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def piece(p: Column) -> Column:
        dec = F.regexp_extract(p, r"^([0-9]{1,9});", 1)
        hexa = F.regexp_extract(p, r"^[xX]([0-9a-fA-F]{1,7});", 1)
        rest = F.substring_index(p, ";", 1)
        tail = p.substr(F.length(rest) + 2, F.length(p))
        return (
            F.when(dec != "", F.concat(char(F.nullif(dec, F.lit("")).cast("long")), tail))
            .when(hexa != "", F.concat(char(F.conv(hexa, 16, 10).cast("long")), tail))
            .otherwise(F.concat(F.lit("&#"), p))
        )

    parts = F.split(t, "&#")
    decoded = bind(parts, lambda b: F.concat(b[0], F.array_join(F.transform(F.slice(b, F.lit(2), F.size(b)), piece), "")))
    return F.when(F.contains(t, F.lit("&#")), decoded).otherwise(t)


def unescape(c: Column) -> Column:
    """Decode numeric references and the named ones that matter for prose, ``&amp;`` last."""
    def decoded(t: Column) -> Column:
        out = _numeric(t)
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
                           ("&nbsp;", "\u00a0"), ("&amp;", "&")):
            out = F.replace(out, F.lit(name), F.lit(char))
        return F.when(F.contains(t, F.lit("&")), out).otherwise(t)

    return bind(c, decoded)


def drop_noise(html: Column) -> Column:
    """Remove comments, scripts, styles and declarations, leaving a text-node break behind."""
    return F.regexp_replace(html, _NOISE, _SEP)


def _tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z][^\s/>]*)", 1))


def _opened(stack: Column, tag: Column) -> Column:
    """Open elements behind a start tag: implied ends first; void and self-closed elements stay out."""
    def after(name: Column) -> Column:
        closed = stack
        for starts, mark, tail in reversed(_IMPLIED):
            closed = F.when(name.isin(starts) & F.contains(stack, F.lit(mark)), F.regexp_replace(stack, tail, "")).otherwise(closed)
        return F.when(name.isin(_VOID) | tag.endswith("/>"), closed).otherwise(F.concat(closed, F.lit("/"), name))

    return bind(_tag_name(tag), after)


def _closed(stack: Column, tag: Column) -> Column:
    """Open elements behind an end tag: cut at the last element of its name; a stray one changes nothing."""
    def after(name: Column) -> Column:
        mark = F.concat(F.lit("/"), name, F.lit("/"))
        whole = F.concat(stack, F.lit("/"))
        back = F.instr(F.reverse(whole), F.reverse(mark))
        cut = F.substring(whole, F.lit(1), F.length(whole) - back - F.length(mark) + 1)
        return F.when(stack.endswith(F.concat(F.lit("/"), name)), F.substring(stack, F.lit(1), F.length(stack) - F.length(name) - 1)).when(
            back > 0, cut).otherwise(stack)

    return bind(_tag_name(tag), after)


def text_nodes(html: Column, opening: str, min_chars: int) -> Column:
    """Trimmed direct text nodes longer than ``min_chars`` of the elements in ``opening``.

    ``opening`` is a tag alternation such as ``p`` or ``td|p|li|span``.
    """
    names = opening.split("|")

    def step(state: Column, token: Column) -> Column:
        stack, out = state["stack"], state["out"]
        is_tag = F.length(token).__gt__(1) & token.startswith("<")
        wanted = F.substring_index(stack, "/", -1).isin(names)
        return F.struct(
            F.when(~is_tag, stack).when(token.startswith("</"), _closed(stack, token)).otherwise(_opened(stack, token)).alias("stack"),
            F.when(~is_tag & wanted, F.concat(out, token)).when(is_tag & ~out.endswith(_SEP), F.concat(out, F.lit(_SEP))).otherwise(out).alias("out"),
        )

    # Appending copies what is there. So each of about sqrt(n) chunks of tokens is folded into a text of its
    # own, which is then appended once: copies add up to n * sqrt(n) small steps and not to n * n.
    def folded(tokens: Column, chunk: Column) -> Column:
        def part(state: Column, i: Column) -> Column:
            begin = F.struct(state["stack"].alias("stack"), F.lit("").alias("out"))
            return bind(F.aggregate(F.slice(tokens, i * chunk + 1, chunk), begin, step),
                        lambda s: F.struct(s["stack"].alias("stack"), F.concat(state["out"], s["out"]).alias("out")))

        start = F.struct(F.lit("").alias("stack"), F.lit(_SEP).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(tokens) / chunk).cast("int")), start, part, lambda s: s["out"])

    tokens = F.regexp_extract_all(drop_noise(html), F.lit(_TOKEN), F.lit(0))
    text = bind(tokens, lambda t: folded(t, F.greatest(F.lit(64), F.sqrt(F.size(t)).cast("int"))))
    nodes = F.transform(F.split(text, _SEP), lambda n: strip_ws(unescape(n)))
    return F.filter(nodes, lambda n: F.length(n) > min_chars)


def _tags(html: Column, name: str) -> Column:
    """All start tags of a name, comments and scripts already gone."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?=[\s/])(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)"), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    """Raw value of an attribute, quoted in either way or not at all; null without it."""
    pairs = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))
    first = F.get(F.filter(pairs, lambda p: p.rlike(rf"(?i)^{name}\s*=")), F.lit(0))

    def value(v: Column) -> Column:
        quoted = v.startswith('"') | v.startswith("'")
        return F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)

    return bind(F.regexp_replace(first, r"^[^=]*=\s*", ""), value)


def _first(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def article_title(html: Column) -> Column:
    """``og:title``, else ``<title>``, else the first heading; emptiness is tested before trimming."""
    def title(clean: Column) -> Column:
        og = F.filter(_tags(clean, "meta"), lambda t: F.coalesce(_attribute(t, "property") == "og:title", F.lit(False)))
        raw = F.coalesce(
            F.nullif(_attribute(F.get(og, F.lit(0)), "content"), F.lit("")),
            _first(clean, r"(?i)<title\b[^>]*>([^<]+)"),
            _first(clean, r"(?i)<h1\b[^>]*>([^<]+)"),
            F.lit(""),
        )
        return strip_ws(unescape(raw))

    return bind(drop_noise(html), title)


def advisory_title(html: Column) -> Column:
    """First second- to fourth-level heading, else ``<title>``."""
    def title(clean: Column) -> Column:
        raw = F.coalesce(
            _first(clean, r"(?i)<h[2-4]\b[^>]*>([^<]+)"),
            _first(clean, r"(?i)<title\b[^>]*>([^<]+)"),
            F.lit(""),
        )
        return strip_ws(unescape(raw))

    return bind(drop_noise(html), title)


def _values(clean: Column, tag: str, name: str) -> Column:
    found = F.transform(_tags(clean, tag), lambda t: _attribute(t, name))
    return F.filter(found, lambda v: v.isNotNull())


def hrefs(html: Column) -> Column:
    """All ``a[href]`` values in document order."""
    return F.transform(_values(drop_noise(html), "a", "href"), unescape)


def base_href(html: Column) -> Column:
    """Value of the first ``base[href]``; null without one."""
    return unescape(F.get(_values(drop_noise(html), "base", "href"), F.lit(0)))


def links(html: Column) -> Column:
    """``struct<base, hrefs>``: both of the above from one clean-up of the markup."""
    return bind(drop_noise(html), lambda clean: F.struct(
        F.when(F.contains(F.lower(clean), F.lit("<base")), unescape(F.get(_values(clean, "base", "href"), F.lit(0)))).alias("base"),
        F.transform(_values(clean, "a", "href"), unescape).alias("hrefs")))
