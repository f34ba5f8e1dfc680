"""Page cleaning and link extraction by one scan over the tags of a page.

Tags end where a parser ends them: a ``>`` in a quoted attribute value does not close
one.  Comments and raw elements (script, style, noscript) go in one pass, whichever
starts first.  Blocks without main content are left out with a depth counter, so blocks
of one name may be nested.

Defined results for broken markup: a block that is never closed is no block, its text
stays; a block closed too seldom ends at its last closing tag; a closing tag without a
block and a block closed within its own tag (``<nav/>``) have no content to leave out;
a raw element or comment that is never closed is an ordinary tag; a sign that starts no
whole tag is text.  A reference that names no character stays as it is.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.text import bind, strip

# --- fixed values: markup that carries no main content ------------------------
RAW_BLOCKS = ["script", "style", "noscript"]
DROPPED_BLOCKS = ["template", "nav", "footer", "header", "aside", "form"]
MAIN_BLOCKS = ["article", "main", "body"]
BLOCK_TAGS = (
    "address|article|blockquote|br|dd|div|dl|dt|figure|figcaption|h[1-6]|hr|li|main|ol|p|pre|"
    "section|table|tbody|thead|tfoot|tr|ul"
)
CELL_TAGS = "td|th"
#: References that are looked up first, being the most frequent.
FREQUENT = ("amp", "nbsp", "lt", "gt", "quot", "apos")

#: What may follow the name of a tag, up to its end; quotes count after a sign of equality.
ATTRIBUTES = r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
ANY_TAG = rf"</?[a-zA-Z]{ATTRIBUTES}>"
COMMENT = r"<!--.*?-->"
#: Tokens whose states are added up together.
TOKEN_BLOCK = 256
BLANKS = r"[ \t\r\n\x{0C}\x{A0}]+"


def opening(tag: str) -> str:
    return rf"<{tag}(?=[\s/>]){ATTRIBUTES}>"


def block_pattern(tag: str) -> str:
    return rf"(?is){opening(tag)}.*?</{tag}\s*>"


def inner_pattern(tag: str) -> str:
    return rf"(?is){opening(tag)}(.*)</{tag}\s*>"


def _character(number: Column) -> Column:
    """The character of a code point; what is none becomes a replacement character."""
    real = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    known = F.when(real, number).otherwise(F.lit(0xFFFD)).cast("bigint")
    return F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")


def _names() -> Column:
    """Names of references and their characters as one map, built from Python's own table.

    Looking up is a walk through the map, so the frequent names stand first.
    """
    named = {n[:-1]: c for n, c in html5.items() if n.endswith(";")} | {"nbsp": " "}
    ordered = [*FREQUENT, *sorted(set(named) - set(FREQUENT))]
    return F.str_to_map(F.lit("\x02".join(f"{n}\x01{named[n]}" for n in ordered)), F.lit("\x02"), F.lit("\x01"))


def decode_entities(col: Column) -> Column:
    """Character references as their characters, each once: ``&amp;lt;`` is ``&lt;``.

    The text is split at its ampersands, so no character that a reference stands for is
    taken for the start of another one.
    """
    names = _names()

    def one(part: Column) -> Column:
        reference = F.regexp_extract(part, r"^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]{1,31});", 1)

        def decoded(ref: Column) -> Column:
            digits = F.substring(ref, 2, 9)
            number = F.when(digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, 8), 16, 10)).otherwise(digits)
            numeric = bind(number.cast("bigint"), lambda n: F.when(n == 160, F.lit(" ")).otherwise(_character(n)))
            character = F.when(ref.startswith("#"), numeric).when(ref != "", F.element_at(names, ref))
            rest = F.substring(part, F.char_length(ref) + 2, F.char_length(part))
            return F.coalesce(F.concat(character, rest), F.concat(F.lit("&"), part))

        return bind(reference, decoded)

    def joined(parts: Column) -> Column:
        return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))

    return bind(col, lambda text: F.when(text.contains("&"), bind(F.split(text, "&"), joined)).otherwise(text))


def decode_utf8(raw: Column) -> Column:
    """Binary page body to text; invalid sequences become replacement characters."""
    return F.make_valid_utf8(raw.cast("string"))


def _without_raw(html: Column, tags: list[str]) -> Column:
    """The page without comments and raw elements; a start inside another one does not count."""
    names = "|".join(tags)
    return F.regexp_replace(html, rf"(?is){COMMENT}|<({names})(?=[\s/>]){ATTRIBUTES}>.*?</\1\s*>", "")


_MARK = rf"</?(?:{'|'.join(DROPPED_BLOCKS)})(?=[\s/>])"
#: A tag of a dropped block, if there is one, and everything up to the next such tag.
_PIECE = rf"(?is)(?:{_MARK}{ATTRIBUTES}>)?+(?:[^<]++|(?!{_MARK})(?:{ANY_TAG}|<))*+"


def _kept_pieces(pieces: Column) -> Column:
    """What stands outside of dropped blocks.

    The state is the name of the outermost open block and the depth of that name.  It is
    carried over blocks of pieces, so that no long array grows piece by piece.
    """
    head = rf"(?is)^<(/?)({'|'.join(DROPPED_BLOCKS)})(?=[\s/>]){ATTRIBUTES}>"

    def parsed(piece: Column, i: Column) -> Column:
        mark = F.regexp_extract(piece, head, 0)
        return bind(
            mark,
            lambda m: F.struct(
                i.alias("i"),
                F.when(m != "", F.lower(F.regexp_extract(m, head, 2))).otherwise("").alias("name"),
                m.startswith("</").alias("closes"),
                m.endswith("/>").alias("empty"),
                F.substring(piece, F.char_length(m) + 1, F.char_length(piece)).alias("rest"),
            ),
        )

    def walked(tokens: Column) -> Column:
        def last(name: str) -> Column:
            """Place of the last closing tag of a name; -1 where there is none."""
            closing = F.filter(tokens, lambda t: t["closes"] & (t["name"] == name))
            return F.coalesce(F.array_max(F.transform(closing, lambda t: t["i"])), F.lit(-1)).alias(name)

        def with_last(ends: Column) -> Column:
            def end_of(name: Column) -> Column:
                found = F.lit(-1)
                for n in DROPPED_BLOCKS:
                    found = F.when(name == n, ends[n]).otherwise(found)
                return found

            def step(state: Column, t: Column) -> Column:
                inside = state["name"] != ""
                opens = (t["name"] != "") & ~t["closes"] & ~t["empty"]
                starts = ~inside & opens & (end_of(t["name"]) > t["i"])
                same = inside & (t["name"] == state["name"])
                depth = state["depth"] + F.when(same & opens, 1).when(same & t["closes"], -1).otherwise(0)
                ended = same & t["closes"] & ((depth == 0) | (end_of(t["name"]) == t["i"]))
                return F.struct(
                    F.when(starts, t["name"]).when(ended, F.lit("")).otherwise(state["name"]).alias("name"),
                    F.when(starts, F.lit(1)).when(ended, F.lit(0)).otherwise(depth).alias("depth"),
                    F.when((~inside & ~starts) | ended, F.concat(state["kept"], F.array(t["rest"]))).otherwise(state["kept"]).alias("kept"),
                )

            def block(state: Column, b: Column) -> Column:
                start = F.struct(state["name"].alias("name"), state["depth"].alias("depth"), F.array().cast("array<string>").alias("kept"))
                done = F.aggregate(F.slice(tokens, b * TOKEN_BLOCK + 1, F.lit(TOKEN_BLOCK)), start, step)
                return bind(
                    done,
                    lambda x: F.struct(
                        x["name"].alias("name"), x["depth"].alias("depth"), F.concat(state["kept"], F.array(F.array_join(x["kept"], ""))).alias("kept")
                    ),
                )

            blocks = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / TOKEN_BLOCK).cast("int"))
            start = F.struct(F.lit("").alias("name"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))
            return F.aggregate(blocks, start, block, lambda s: F.array_join(s["kept"], ""))

        return bind(F.struct(*[last(n) for n in DROPPED_BLOCKS]), with_last)

    return bind(F.transform(pieces, parsed), walked)


def _without_blocks(html: Column) -> Column:
    def scanned(page: Column) -> Column:
        pieces = F.regexp_extract_all(page, F.lit(_PIECE), F.lit(0))
        return F.when(F.regexp_like(page, F.lit(rf"(?i){_MARK}")), _kept_pieces(pieces)).otherwise(page)

    return bind(_without_raw(html, RAW_BLOCKS), scanned)


def _first_block(whole: Column) -> Column:
    """Content of the first kind of main block there is; all but the head without a body."""
    body = F.regexp_replace(whole, block_pattern("head"), "")
    for tag in reversed(MAIN_BLOCKS):
        has_tag = F.regexp_like(whole, F.lit(rf"(?i)<{tag}[\s>]"))
        body = F.when(has_tag, F.regexp_extract(whole, inner_pattern(tag), 1)).otherwise(body)
    return body


def main_text(html: Column) -> Column:
    """Main content as lines of text; an empty string if there is none."""
    col = bind(_without_blocks(html), _first_block)
    col = F.regexp_replace(col, BLANKS, " ")
    col = F.regexp_replace(col, rf"(?i)</?(?:{BLOCK_TAGS})(?=[\s/>]){ATTRIBUTES}>", "\n")
    col = F.regexp_replace(col, rf"(?i)</(?:{CELL_TAGS})\s*>", " | ")
    col = F.regexp_replace(col, rf"{ANY_TAG}|<[!?/][^>]*>", "")
    col = decode_entities(col)
    col = F.regexp_replace(col, r" *\n[ \n]*", "\n")
    col = F.regexp_replace(col, r" {2,}", " ")
    return strip(col)


def page_title(html: Column) -> Column:
    """``<title>``, else the first ``<h1>``, else NULL."""
    def inner(tag: str) -> Column:
        found = F.regexp_extract(html, rf"(?is){opening(tag)}(.*?)</{tag}\s*>", 1)
        found = F.regexp_replace(found, rf"{ANY_TAG}|<[!?/][^>]*>", "")
        found = strip(F.regexp_replace(decode_entities(found), BLANKS, " "))
        return bind(found, lambda t: F.when(t != "", t))

    return F.coalesce(inner("title"), inner("h1"))


def needs_render(html: Column) -> Column:
    """Page that looks rendered by script: a bare noscript tag, or very few bytes."""
    return F.contains(html, F.lit("<noscript>")) | (F.octet_length(html) < config.RENDER_MIN_BYTES)


#: The start tags of links.
LINK_TAG = rf"(?i)<a(?=\s){ATTRIBUTES}>"
#: Within such a tag the attributes before the target, and the target with its quotes.
TARGET = (
    r"""(?i)^<a(?:[\s/]*+(?!href\s*+=)[^\s=>/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']?+[^\s>]*+))?+)*+"""
    r"""[\s/]*+href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
)


def hrefs(html: Column) -> Column:
    """All link targets of a page, in page order, their references decoded.

    Links within comments, scripts and styles are none; an attribute whose value looks
    like a target is none either.
    """
    tags = F.regexp_extract_all(_without_raw(html, ["script", "style"]), F.lit(LINK_TAG), F.lit(0))
    quoted = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, TARGET, 1)), lambda v: v != "")
    bare = lambda v: F.when(v.rlike("^[\"']"), F.substring(v, 2, F.char_length(v) - 2)).otherwise(v)
    return F.transform(quoted, lambda v: decode_entities(bare(v)))
