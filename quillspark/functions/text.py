"""Column functions on text: tokens, counts, marks, escapes and folds."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token classes: of the index, of typed queries (narrower), of the lexicon (case kept).
INDEX_CLASS, SEARCH_CLASS, LEXICON_CLASS = r"\p{L}+", "[a-z]+", r"\p{L}+"
#: The classes of the Georgian corpus (with and without archaic letters).
GEORGIAN_SEARCH, GEORGIAN_INDEX, GEORGIAN_LEXICON = "[ა-ჰ]+", "[ა-ჰჱჲჳჴჵa-zA-Z]+", "[ა-ჰჱჲჳჴჵ]+"


def _chars(first: int, last: int) -> str:
    return "".join(map(chr, range(first, last + 1)))


#: Capital and ecclesiastical letters and the everyday letters they stand for.
ASOMTAVRULI, NUSKHURI, MKHEDRULI = _chars(0x10A0, 0x10C5), _chars(0x2D00, 0x2D25), _chars(0x10D0, 0x10F5)
#: Archaic letters that searches treat as their modern neighbours.
ARCHAIC, MODERN = "ჱჲჳჴჵ", "ეივხო"


def tokens(text: Column, token_class: str = INDEX_CLASS, lower: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(token_class), F.lit(0))


def fold_script(text: Column) -> Column:
    """Both old scripts to the everyday one; must come before lower-casing.  Texts without their letters are left as they are, as ``translate`` looks up every character."""
    old = f"[{ASOMTAVRULI[0]}-{ASOMTAVRULI[-1]}{NUSKHURI[0]}-{NUSKHURI[-1]}]"
    return F.when(F.rlike(text, F.lit(old)), F.translate(text, ASOMTAVRULI + NUSKHURI, MKHEDRULI * 2)).otherwise(text)


def unfold_script(text: Column) -> Column:
    return F.translate(text, MKHEDRULI, ASOMTAVRULI)


def fold_archaic(text: Column) -> Column:
    return F.translate(text, ARCHAIC, MODERN)


def literal_pattern(text: str) -> str:
    """A pattern that matches ``text`` itself, in Java's and Python's syntax alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def count_word(text: Column, word: str) -> Column:
    """Whole-word hits, in any case, with Unicode word boundaries."""
    return F.regexp_count(text, F.lit(rf"(?iuU)\b{literal_pattern(word)}\b")).cast("bigint")


def count_phrase(text: Column, phrase: str) -> Column:
    """Hits that begin at a word boundary; suffixes are allowed."""
    return F.regexp_count(text, F.lit(rf"(?iuU)\b{literal_pattern(phrase)}")).cast("bigint")


def escape_html(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def render_note(note: Column, books: dict[str, str]) -> Column:
    """A note in light markup as HTML: headings, lists, quotes, strong and emphasis, and links ``[[book 1:2-3]]`` to known books.

    All text is escaped first.  A link to a book that is none of ``books`` (name in lower case -> slug) is marked as such.
    """
    rules = ((r"^###\s+", "h4"), (r"^##\s+", "h3"), (r"^#\s+", "h2"), (r"^[-*]\s+", "li"), (r"^&gt;\s+", "blockquote"))

    def block(line: Column) -> Column:
        out = reduce(lambda c, r: c.when(line.rlike(r[0]), F.concat(F.lit(f"<{r[1]}>"), F.regexp_replace(line, r[0], ""), F.lit(f"</{r[1]}>"))), rules[1:], F.when(line.rlike(rules[0][0]), F.concat(F.lit("<h4>"), F.regexp_replace(line, rules[0][0], ""), F.lit("</h4>"))))
        return out.otherwise(line)

    lines = F.transform(F.split(escape_html(note), "\n"), block)
    item = lambda x: F.startswith(F.coalesce(x, F.lit("")), F.lit("<li>"))
    listed = F.transform(
        lines,
        lambda x, i: F.concat(F.when(item(x) & ((i == 0) | ~item(F.get(lines, i - 1))), "<ul>\n").otherwise(""), x, F.when(item(x) & ~item(F.get(lines, i + 1)), "\n</ul>").otherwise("")),
    )
    marked = F.regexp_replace(F.regexp_replace(F.array_join(listed, "\n"), r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), r"(?<!\*)\*([^*]+)\*(?!\*)", "<em>$1</em>")
    table = F.create_map(*(F.lit(x) for kv in books.items() for x in kv))
    shape = r"^\s*(.+?)\s+(\d+):(\d+)(?:-(\d+))?\s*$"

    def link(piece: Column) -> Column:
        inner = F.regexp_extract(piece, r"^\[\[([^\]]+)\]\]$", 1)
        part = lambda i: F.regexp_extract(inner, shape, i)
        slug, text = table[F.lower(F.trim(part(1)))], escape_html(inner)
        until = F.when(part(4) != "", F.concat(F.lit(' data-verse-end="'), part(4), F.lit('"'))).otherwise("")
        known = F.concat(F.lit('<a class="verse-link" data-slug="'), slug, F.lit('" data-chapter="'), part(2), F.lit('" data-verse="'), part(3), F.lit('"'), until, F.lit(' data-ref="'), text, F.lit('">'), text, F.lit("</a>"))
        return F.when(inner == "", piece).when(slug.isNotNull(), known).otherwise(F.concat(F.lit('<span class="verse-link-invalid">[['), text, F.lit("]]</span>")))

    pieces = F.regexp_extract_all(marked, F.lit(r"\[\[[^\]]+\]\]|(?:(?!\[\[[^\]]+\]\])[\s\S])+"), F.lit(0))
    linked = F.split(F.array_join(F.transform(pieces, link), ""), "\n")
    ended = F.transform(linked, lambda x: F.when(F.trim(x) == "", "").when(F.trim(x).rlike("^</?(h[234]|ul|li|blockquote)>"), x).otherwise(F.concat(x, F.lit("<br>"))))
    return F.array_join(ended, "\n")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def preview(new: Column, old: Column, width: int = 200) -> Column:
    """The first ``width`` characters of ``new``, else of ``old``, with dots if there is more."""
    text = F.coalesce(F.nullif(new, F.lit("")), old, F.lit(""))
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def range_label(chapter: Column, first: Column, last: Column) -> Column:
    head = F.concat(chapter.cast("string"), F.lit(":"), first.cast("string"))
    return F.when(first == last, head).otherwise(F.concat(head, F.lit("-"), last.cast("string")))


def parse_search(q: str) -> tuple[str, list[str]]:
    """('phrase', [text]) for a query in matching quotes, else ('single' or 'and' or 'empty', words)."""
    q = q.strip()
    if len(q) >= 2 and q[0] == q[-1] and q[0] in "\"'" and q[1:-1].strip():
        return "phrase", [q[1:-1].strip()]
    words = re.findall(SEARCH_CLASS, q.lower())
    return ("empty" if not words else "single" if len(words) == 1 else "and"), words


#: The most rows that a question of each kind may ask for.
MOST_ROWS = {"keywords": 2000, "references": 50, "topics": 100, "testament": 500, "letter": 2000, "words": 500, "verses": 100}


def clamp_limit(limit: int, cap: int | str) -> int:
    """``limit``, not below 0 and not above a cap, given as a number or as a kind of question."""
    return min(max(limit, 0), MOST_ROWS[cap] if isinstance(cap, str) else cap)
