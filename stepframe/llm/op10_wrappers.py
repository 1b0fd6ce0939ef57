"""Main text of web pages by union-free regular expressions (wrappers) inferred from the pages of a host.

A page is a stream of tags (name and the words of class, id and role) and text slots. Repeated neighbours fold into groups, ``( li a # /a /li )+``;
pages of a host with the same folded stream count as one, so a host with a third of all pages costs as many rows as it has
layouts. The layouts of a host, most frequent first, are aligned one by one: what both hold stays, other stretches become
optional groups, a stretch that is a known repeated group becomes that group. The result is the host's wrapper, a
union-free expression over tags and slots. Slots carry their texts (those of a repeated group together), so aligning compares
them: a slot whose text is the same on all pages that hold it is template and not part of a page's text. It takes three such pages
of different text, and of the host's pages a fifth in plain regions or all of them in article or main regions, where near copies of
one article would look like template otherwise. A page of nothing but template keeps its text.
Slots that differ between pages are told apart by their place: those in navigation, headers, footers, sidebars, notices, adverts,
forms, comments, scripts and styles are left out by fixed lists of tags and class words, and if the page has an article or main
region only slots in it count (a heading block inside it stays).

Blocks are joined by one space, white space inside them is one space, character references are decoded. Null or textless
pages give an empty text. Repeated rows are extracted each; an empty table gives no rows; extra columns are not read.
Text is never cut.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from difflib import SequenceMatcher
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.llm.shared import ship, stored

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span",
    "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
NOISE_TAGS = {"nav", "footer", "aside", "form", "head", "title", "button", "select", "option", "iframe", "dialog", "menu", "object", "video", "audio", "canvas"}
NOISE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "notice", "gdpr", "comment", "comments",
    "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "share", "social", "related", "newsletter", "subscribe", "signup", "login", "popup",
    "modal", "footer", "pagination", "pager", "widget", "masthead", "topbar", "toolbar", "search", "disclaimer", "alert", "complementary", "contentinfo", "respond", "replies",
}
MAIN_TAGS = {"article", "main"}
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story"}
#: Tags that an opening tag of the same list closes when it is left open.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in ("div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "aside", "nav", "footer", "header", "form", "blockquote", "pre", "hr")}
GROUP = 24
LETTER = 0xE000


def tokens(page: str):
    """(symbol, text): an opening tag "name" or "name.class.id.role" with all words, "/name", or "#" with its text."""
    for m in TOKEN.finditer(page):
        t = m[0]
        if m[1]:
            continue
        if t[0] != "<" or t == "<":
            yield "#", t
        elif tag := TAG.match(t):
            name = tag[2].lower()
            if tag[1]:
                yield "/" + name, ""
            else:
                words = " ".join(x for found in CLASS.findall(t) for x in found if x).split()
                yield ".".join([name, *words]), ""


def walk(symbols):
    """The stack of open tags at every symbol, with the closing that HTML implies."""
    stack: list[str] = []
    for s in symbols:
        if s[0] == "/":
            name = s[1:]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].split(".", 1)[0] == name:
                    del stack[k:]
                    break
        elif s != "#":
            name = s.split(".", 1)[0]
            for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[k].split(".", 1)[0] in CLOSES.get(name, ()):
                    del stack[k:]
                    break
            if name not in VOID:
                stack.append(s)
        yield stack


def place(stack: list[str]) -> str:
    """A slot's place: the open tags that aren't inline."""
    return " ".join(x for x in stack if x.split(".", 1)[0] not in INLINE or "." in x)


def _is(symbol: str, tags: set[str], marks: set[str]) -> bool:
    name, *words = symbol.split(".")
    return name in tags or any(p in marks for w in words for p in re.split(r"[-_]+", w.lower()))


def judged(where: str) -> tuple[bool, bool]:
    """Whether a place is in a main region, and whether it is noise."""
    stack = where.split()
    main = next((k for k in range(len(stack) - 1, -1, -1) if _is(stack[k], MAIN_TAGS, MAIN_WORDS) and stack[k] not in ("html", "body")), None)
    noise = any(_is(x, NOISE_TAGS, NOISE_WORDS) and not x.startswith(("html", "body")) for x in stack)
    head = any(x.split(".", 1)[0] == "header" for x in (stack if main is None else stack[:main]))
    return main is not None, noise or head


# Wrappers: lists whose items are symbols or [mark, items] with mark "+" or "?".


class Slot(str):
    """A text slot: the hash of its texts (0 once pages differ), its pages, and hashes of up to ENOUGH different texts of theirs."""

    def __new__(cls, value: int, n: int, texts: list[int]):
        self = super().__new__(cls, "#")
        self.value, self.n, self.texts, self.into = value, n, texts, None
        return self

    def root(self) -> Slot:
        return self if self.into is None else self.into.root()

    def take(self, other: Slot) -> None:
        self.value = self.value if self.value == other.value else 0
        self.n += other.n
        self.texts = sorted({*self.texts, *other.texts})[:ENOUGH]
        other.into = self


def hashed(parts) -> int:
    """A positive number for texts in their order."""
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1 | 1


def fold(symbols: list[str]) -> list:
    """Fold repeated neighbours into groups, the shortest groups first."""
    return folded(symbols)[0]


def folded(symbols: list[str]) -> tuple[list, list[list[int]]]:
    """The folded stream, and for each of its slots where in the stream its texts are."""
    letters = {s: chr(LETTER + i) for i, s in enumerate(dict.fromkeys(symbols))}
    items: dict[str, object] = {c: s for s, c in letters.items()}
    text = "".join(letters[s] for s in symbols)
    held = [[[i]] if s == "#" else [] for i, s in enumerate(symbols)]  # for each letter of the text, the texts of each of its slots
    known: dict[str, str] = {}
    for _ in range(6):
        after, kept, at = [], [], 0
        for m in re.finditer(rf"(.{{2,{GROUP}}}?)\1+", text, flags=re.S):
            c = known.setdefault(m[1], chr(LETTER + len(items)))
            items.setdefault(c, ["+", [items[x] for x in m[1]]])
            rounds = [[x for h in held[k : k + len(m[1])] for x in h] for k in range(m.start(), m.end(), len(m[1]))]
            after += [text[at : m.start()], c]
            kept += [*held[at : m.start()], [[i for part in same for i in part] for same in zip(*rounds, strict=True)]]
            at = m.end()
        if not after:
            break
        text, held = "".join(after) + text[at:], kept + held[at:]
    return [items[c] for c in text], [x for h in held for x in h]


def bare(item) -> str:
    return item if isinstance(item, str) else "(" + " ".join(map(bare, item[1])) + ")"


def refold(items: list, other: list) -> list:
    """Put in groups that ``other`` repeats where ``items`` hold their content once."""
    groups = dict.fromkeys(tuple(map(bare, x[1])) for x in other if not isinstance(x, str) and x[0] == "+")
    out: list = []
    k = 0
    while k < len(items):
        for content in groups:
            if tuple(map(bare, items[k : k + len(content)])) == content:
                out.append(["+", items[k : k + len(content)]])
                k += len(content)
                break
        else:
            out.append(items[k])
            k += 1
    return out


def align(wrapper: list, page: list) -> list:
    """The least general expression of the two that this inference makes: matches stay, the rest becomes optional."""
    wrapper, page = refold(wrapper, page), refold(page, wrapper)
    flat = [x[1] if not isinstance(x, str) and x[0] == "?" else [x] for x in wrapper]
    spread = [(bare(y), k) for k, x in enumerate(flat) for y in x]
    out: list = []
    used = [x for xs in flat for x in xs]
    is_optional = [not isinstance(x, str) and x[0] == "?" for x in wrapper]

    def runs(a: int, b: int):
        """Stretches of the items from a to b: each optional group by itself, others together."""
        for key, run in groupby(range(a, b), lambda k: spread[k][1] if is_optional[spread[k][1]] else -1):
            yield key >= 0, [used[k] for k in run]

    for op, a, b, c, d in SequenceMatcher(None, [s for s, _ in spread], [bare(x) for x in page], autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(symbols_of(used[a:b]), symbols_of(page[c:d]), strict=True):
                if isinstance(x, Slot) and isinstance(y, Slot):
                    x.take(y)
            for optional, run in runs(a, b):
                out += [["?", run]] if optional else run
        else:
            out += [["?", run] for _, run in runs(a, b)]
            if d > c:
                out.append(["?", page[c:d]])
    return out


def expression(items: list) -> str:
    """The wrapper as text: tags, ``#`` for a slot, ``( )+`` and ``( )?``."""
    return " ".join(x if isinstance(x, str) else f"( {expression(x[1])} ){x[0]}" for x in items)


def symbols_of(items: list) -> list[str]:
    return [s for x in items for s in ([x] if isinstance(x, str) else symbols_of(x[1]))]


def accepts(items: list, symbols: list[str]) -> bool:
    """Whether the expression matches a whole stream."""
    letters: dict[str, str] = {}
    letter = lambda s: letters.setdefault(s, chr(LETTER + len(letters)))

    def pattern(xs) -> str:
        return "".join(letter(x) if isinstance(x, str) else f"(?:{pattern(x[1])}){x[0]}" for x in xs)

    return re.fullmatch(pattern(items), "".join(map(letter, symbols))) is not None


MAIN, PLAIN, NOISE = 2, 1, 0
#: Pages of different text that must agree on a slot's text, and the share of a host's pages (one in so many) that a plain one must be on.
ENOUGH, SHARE = 3, 5


def rank(where: str) -> int:
    main, noise = judged(where)
    return NOISE if noise else MAIN if main else PLAIN


def slots(items: list) -> dict[str, int]:
    """Rank of each place where the wrapper has a slot."""
    return {p: rank(p) for p in dict.fromkeys(places_of(items))}


def infer(layouts: list[list]) -> list:
    wrapper = layouts[0]
    for page in layouts[1:]:
        wrapper = align(wrapper, page)
    return wrapper


def least_rank(symbols: list[str]) -> int:
    """MAIN if the page has a main region."""
    return MAIN if any(s not in ("#", "html", "body") and s[0] != "/" and _is(s, MAIN_TAGS, MAIN_WORDS) for s in dict.fromkeys(symbols)) else PLAIN


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


class Layouts(dict):
    """By a page's stream: the folded stream as JSON, the texts and the place of each slot, and which slots count by their place."""

    def __missing__(self, raw: str):
        if len(self) > 5000:
            self.clear()
        symbols = raw.split(" ")
        items, texts = folded(symbols)
        places, least = places_of(items), least_rank(symbols)
        got = self[raw] = json.dumps(items), texts, places, [k for k, p in enumerate(places) if rank(p) >= least]
        return got


def places_of(items: list) -> list[str]:
    """The place of each slot, in order."""
    symbols = symbols_of(items)
    return [place(stack) for s, stack in zip(symbols, walk(symbols), strict=True) if s == "#"]


def read(found: list[tuple[str, str]], layouts: Layouts):
    """The layout of a page, where each of its slots stands in ``found``, and the hash of each slot's texts."""
    at = [k for k, (s, t) in enumerate(found) if s != "#" or t.strip()]
    got = layouts[" ".join(found[k][0] for k in at)]
    where = [[at[i] for i in texts] for texts in got[1]]
    return got, where, [hashed(clean(found[k][1]) for k in ks) for ks in where]


def with_slots(items: list, slots) -> list:
    """The items with the next of ``slots`` in place of each text."""
    return [(next(slots) if x == "#" else x) if isinstance(x, str) else [x[0], with_slots(x[1], slots)] for x in items]


def template(layouts: list[list], total: int) -> set[tuple[str, int]]:
    """(place, hash of texts) of the slots that are template, when the layouts have been aligned."""
    out = set()
    for items in layouts:
        for where, slot in zip(places_of(items), (s for s in symbols_of(items) if s == "#"), strict=True):
            own, r = slot.root(), rank(where)
            if own.value and len(own.texts) >= ENOUGH and (r == MAIN and own.n == total or r == PLAIN and own.n * SHARE >= total):
                out.add((where, own.value))
    return out


def text_of(page: str | None, known: dict[str, int], constant: set[tuple[str, int]] = frozenset(), layouts: Layouts | None = None) -> str:
    """The main text of a page; ``known`` keeps the ranks of places, ``constant`` is its host's template."""
    if not page:
        return ""
    found = list(tokens(page))
    text = ""
    if constant and any(s != "#" or t.strip() for s, t in found):
        (_, _, places, _), where, values = read(found, Layouts() if layouts is None else layouts)
        gone = {k for ks, key in zip(where, zip(places, values, strict=True), strict=True) if key in constant for k in ks}
        text = text_without(gone, found, known)
    return text or text_without(set(), found, known)


def text_without(gone: set[int], found: list[tuple[str, str]], known: dict[str, int]) -> str:
    symbols = [s for s, _ in found]
    least = least_rank(symbols)
    blocks: list[str] = []
    held: list[str] = []
    for k, ((s, text), stack) in enumerate(zip(found, walk(symbols), strict=True)):
        if s == "#":
            where = place(stack)
            if where not in known:
                known[where] = rank(where)
            if known[where] >= least and k not in gone:
                held.append(text)
        elif s.lstrip("/").split(".", 1)[0] not in INLINE and held:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    return " ".join(b for b in map(clean, blocks) if b)


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (expression), template (JSON of places and hashes of texts), from all pages (host, html)."""

    def run(batches):
        for b in batches:
            out: dict = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = list(tokens(page)) if page else []
                if any(s != "#" or t.strip() for s, t in found):
                    (layout, _, _, counted), _, values = read(found, layouts)
                    one = Slot(0, 1, [hashed(str(values[k]) for k in counted)])
                    if (host, layout) in out:
                        all_, had = out[host, layout]
                        all_.take(one)
                        out[host, layout] = all_, [x if x == y else 0 for x, y in zip(had, values, strict=True)]
                    else:
                        out[host, layout] = one, values
            columns = [k for k, _ in out], [k for _, k in out], [x.n for x, _ in out.values()], [v for _, v in out.values()], [x.texts for x, _ in out.values()]
            kinds = pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "layout", "n", "vals", "texts"])

    layouts = Layouts()

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "layout"], ascending=[False, True])
        own = [
            with_slots(json.loads(layout), iter([Slot(int(v), int(n), [int(x) for x in texts]) for v in vals]))
            for layout, n, vals, texts in zip(pdf["layout"], pdf["n"], pdf["vals"], pdf["texts"], strict=True)
        ]
        w = infer(own)
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": [expression(w)], "template": [json.dumps(sorted(template(own, int(pdf["n"].sum()))))]})

    counts = pages.mapInArrow(run, "host string, layout string, n long, vals array<long>, texts array<long>").groupBy("host", "layout").agg(
        F.sum("n").alias("n"), F.collect_list("vals").alias("vals"), F.array_distinct(F.flatten(F.collect_list("texts"))).alias("texts")
    )
    agreed = F.aggregate("vals", F.col("vals")[0], lambda a, b: F.zip_with(a, b, lambda x, y: F.when(x == y, x).otherwise(F.lit(0).cast("long"))))
    counts = counts.select("host", "layout", "n", agreed.alias("vals"), F.slice(F.array_sort("texts"), 1, ENOUGH).alias("texts"))
    return counts.groupBy("host").applyInPandas(together, "host string, wrapper string, template string")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host_of(url).alias("host"), F.col(page).alias("html"))
    known = stored(wrappers(rows.select("host", "html")).select("host", "template"), "wrappers")

    def run(batches):
        held: dict[str, set[tuple[str, int]]] = {}
        ranks: dict[str, int] = {}
        layouts = Layouts()
        for b in batches:
            out = []
            if len(ranks) > 100_000:
                ranks.clear()
            for s, h in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                s = s or "[]"
                if s not in held:
                    if len(held) > 2000:
                        held.clear()
                    held[s] = {(where, value) for where, value in json.loads(s)}
                out.append(text_of(h, ranks, held[s], layouts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.join(known, "host", "left").select("page_id", "url", "template", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
