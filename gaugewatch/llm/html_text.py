"""Main text of web pages by deducing the template of each host.

1. Every page is walked once. Its tokens are the tags, named by the path of
   elements they open in, and the texts, also those of an article. A token's
   occurrence vector holds its count on each page of the host; it travels as
   one number, the sum of ``count * hash(page)``, so that tokens of any host,
   however large, are added up by a partial aggregate.
2. Tokens of a host with equal vectors are an equivalence class, and a class is
   kept or dropped as a whole. It is valid if it is on enough different pages.
   Valid classes are nested into a template from the document's root down: every
   member must lie in an element of the template or of its class. For a text of an
   article (or main) that element is the article: only a text with the vector
   of its article is the template's, so what varies there is a slot, however
   frequent it is.
3. What the template does not cover are slots; all slots of a page are its
   main text, in or outside of an article (or main) element, and texts that
   are tokens of the template are not. Nothing is main text below an element
   that is a menu, a header, a footer, a sidebar, a notice, an advert, a form,
   a script, a style or a place for reader comments, by its tag, role or class.
   A class or id says so as a whole token, alone or with words that name only
   a place or a form (``site-footer``, ``ad-slot``; not ``has-sidebar``), and
   never alone for an element that holds all articles of the page or, on a page
   without an article elsewhere, most of its text; a header in an article is
   its heading.

Pages of a host too small for a template are their own template; there, an
article that holds at least half of the page's text is taken for the slot.
The article is also taken if a template covers a whole page. Copies of a page
count once, so they do not make their text a part of the template; for texts
in an article, pages that share their longest text there are copies.

Character references are decoded; a start or end tag of a block element, or a
line break element, ends a block; white space in a block becomes one space;
empty blocks are left out; blocks are joined by a line feed in page order.

Null html is empty and gives an empty text. A null address belongs to the
host "". Repeated rows give repeated results; an empty table an empty one.
Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewatch.llm.common import batches
from gaugewatch.session import fresh_path

SHARE = 0.5
MIN_PAGES = 3
BROADCAST_NUMBERS = 4_000_000
CHUNK = 8 << 20

# Elements by their use in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
NOISE = frozenset(
    "script style noscript template head title nav footer aside form button select textarea iframe object svg canvas menu "
    "dialog audio video".split()
)
ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner banners menu "
    "menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars footer footers header headers masthead topbar comment "
    "comments commentlist disqus replies respond notice notices cookie cookies consent gdpr popup modal overlay newsletter "
    "subscribe subscription signup login related share sharing social widget widgets pagination pager skip toolbar".split()
)
# Parts of a class that leave the meaning of the names beside them.
PLAIN = frozenset(
    "site main global top bottom left right upper lower inner outer bar box block container wrapper wrap inline area section zone slot "
    "unit list links link items item buttons button icons form posts articles stories primary secondary mobile desktop js".split()
)
HEADERS = frozenset("header headers".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
RAW = frozenset({"title", "textarea"})
CONTENT = frozenset({"article", "main"})
CLOSES = {
    "p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
SCOPES = frozenset("html body article main section div aside nav header footer form ul ol dl table blockquote".split())
WORD = re.compile(r"[a-z0-9]+")
CUT = re.compile(r"<!--|</?[A-Za-z!?][^>]*\Z")
NO_NAME: tuple[int, ...] = ()
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


class Walk(HTMLParser):
    """One page as a list of (path, noise, in content, text) for its texts, and counts of its tokens.

    Noise by names is settled at the end of the page, when it is known what the named elements hold: until
    then a text carries the numbers of those it lies in.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, bool, bool, tuple[int, ...]]] = []
        self.texts: list[tuple[str, bool, bool, str, tuple[int, ...]] | None] = []  # None: a block ends
        self.tags: Counter = Counter()
        self.named: list[bool] = []  # of each named element: whether it is a place for comments
        self.feed(html)
        # What the parser holds back: a comment or a tag that the end of the page cuts off is no text.
        if self.cdata_elem is None and CUT.match(self.rawdata):
            self.rawdata = ""
        self.close()
        self.kept = self._not_by_name_alone() if self.named else frozenset()

    def _not_by_name_alone(self) -> frozenset[int]:
        """Named elements that are no noise, as the page has no article outside of them and they hold it or most text."""
        held: Counter = Counter()
        inside: set[tuple[int, ...]] = set()
        total = 0
        for item in self.texts:
            if item and not item[1] and (size := len(item[3].strip())):
                total += size
                for k in item[4]:
                    held[k] += size
                if item[2]:
                    inside.add(item[4])
        if () in inside:
            return frozenset()
        kept = {k for k, size in held.items() if 2 * size > total and not self.named[k]}
        # If every article lies in named elements: those around them, from the outermost on, until one is free.
        depth = 0
        while inside and not any(kept.issuperset(names) for names in inside):
            kept |= {names[depth] for names in inside if len(names) > depth}
            depth += 1
        return frozenset(kept)

    def _top(self) -> tuple[str, str, bool, bool, tuple[int, ...]]:
        return self.stack[-1] if self.stack else ("", "", False, False, NO_NAME)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.texts.append(None)
        if tag in VOID:
            return
        closed = CLOSES.get(tag)
        if closed or tag in BLOCK:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in (closed or CLOSES["p"]):
                    del self.stack[k:]
                    break
                if self.stack[k][0] in SCOPES:
                    break
        if tag in RAW:
            self.set_cdata_mode(tag)
        _, path, noise, content, inside = self._top()
        values = {k: v or "" for k, v in attrs}
        named = f"{values.get('class', '')} {values.get('id', '')}".lower() if "class" in values or "id" in values else ""
        names = set(WORD.findall(named))
        noise = (
            noise or tag in NOISE or (tag == "header" and not content) or values.get("role", "").lower() in ROLES
            or "hidden" in values
        )
        if not noise and names & NAMES and tag not in ("html", "body") and tag not in CONTENT:
            if said := _noise_names(named, content):
                inside = (*inside, len(self.named))
                self.named.append(bool(said & COMMENTS))
        if tag in BLOCK or names:
            path = f"{path}/{tag}" + ("." + ".".join(sorted(names)) if names and tag not in ("html", "body") else "")
            self.tags[path] += 1
        self.stack.append((tag, path, noise, content or (tag in CONTENT and not noise), inside))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.texts.append(None)
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data: str) -> None:
        _, path, noise, content, inside = self._top()
        self.texts.append((path, noise, content, data, inside))

    def tokens(self) -> tuple[Counter, Counter, str]:
        """What may be a template's: paths of elements and texts outside of content; articles, their texts, and the longest."""
        found = Counter({f"<{path}": n for path, n in self.tags.items()})
        inside, longest = Counter(), ""
        for path, content, block in self.blocks():
            (inside if content else found)[f"{path}>{block}"] += 1
            if content:
                longest = max(longest, block, key=len)
        inside.update({f"^{article}": 1 for article in {_article(token.partition(">")[0]) for token in inside}})
        return found, inside, longest

    def blocks(self) -> Iterator[tuple[str, bool, str]]:
        """(path, in content, text) of the blocks made of texts that are no noise."""
        path, content, parts = "", False, []
        for item in [*self.texts, None]:
            if item is None:
                text = " ".join("".join(parts).split())
                if text:
                    yield path, content, text
                parts = []
            elif not item[1] and (not item[4] or self.kept.issuperset(item[4])):
                if not parts:
                    path, content = item[0], item[2]
                parts.append(item[3])


@functools.lru_cache(65_536)
def _noise_names(named: str, content: bool) -> frozenset[str]:
    """Names of noise among whole class tokens."""
    found: set[str] = set()
    for token in named.split():
        parts = set(WORD.findall(token))
        own = parts & (NAMES - HEADERS if content else NAMES)
        if own and all(p in NAMES or p in PLAIN or p.isdigit() for p in parts):
            found |= own
    return frozenset(found)


@functools.lru_cache(65_536)
def _article(path: str) -> str:
    """The part of a path up to its outermost article or main element; all of it, if the element has a name of its own."""
    steps = path.split("/")
    for k, step in enumerate(steps):
        if step.partition(".")[0] in CONTENT:
            return "/".join(steps[: k + 1])
    return path


def token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token) - (1 << 63)


@functools.lru_cache(65_536)
def _path_hash(path: str) -> int:
    """Of the tag token of a path; 0 is the document."""
    return token_hash(f"<{path}") if path else 0


def main_text(html: str, template: set[int] | None) -> str:
    """Text of the page's main slots; a page without a template is its own."""
    walk = Walk(html)
    slots = list(walk.blocks())
    article = [text for _, content, text in slots if content]
    if template:
        texts = [text for path, _, text in slots if token_hash(f"{path}>{text}") not in template] or article
    elif 2 * sum(map(len, article)) >= sum(len(text) for _, _, text in slots):
        texts = article
    else:
        texts = [text for _, _, text in slots]
    return "\n".join(texts)


def _columns(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, token): tags and texts of the valid, nested equivalence classes of each host."""
    rows = _columns(pages).select("host", "html")

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, CHUNK, "html"):
            out = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found, inside, longest = Walk(html).tokens()
                for tokens, of in ((found, html), (inside, longest)):
                    page = xxhash.xxh64_intdigest(of)
                    votes = {count: xxhash.xxh64_intdigest(str(count), page) >> 8 for count in set(tokens.values())}
                    for token, count in tokens.items():
                        if token[0] == "<":
                            out.append((host, votes[count], _path_hash(token[1:]), _path_hash(token[1:].rpartition("/")[0]), False))
                        elif token[0] == "^":
                            out.append((host, votes[count], token_hash(token), 0, False))
                        else:
                            path = token.partition(">")[0]
                            parent = token_hash(f"^{_article(path)}") if tokens is inside else _path_hash(path)
                            out.append((host, votes[count], token_hash(token), parent, tokens is inside))
            if out:
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["host", "vote", "token", "parent", "inner"]
                )

    # Copies of a page count once: their rows are equal.
    found = rows.mapInArrow(run, "host string, vote long, token long, parent long, inner boolean").distinct()
    vector = F.sum(F.col("vote").cast("decimal(20,0)")).alias("vector")
    tokens = found.groupBy("host", "token", "parent", "inner").agg(vector, F.count("*").alias("pages"))
    tokens = tokens.where(F.col("pages") >= MIN_PAGES)
    whole = tokens.groupBy("host").agg(F.max("pages").alias("whole"))
    tokens = tokens.join(whole, "host").where(F.col("pages") >= SHARE * F.col("whole"))
    classes = tokens.groupBy("host", "vector").agg(F.collect_set(F.struct("token", "parent", "inner")).alias("members"))
    # A host's frequent tokens are those of its template: few, whatever its number of pages.
    nested = classes.groupBy("host").agg(F.collect_list("members").alias("classes"))

    def nest(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for host, groups in zip(batch.column("host").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                kept = nested_classes([[(m["token"], m["parent"], m["inner"]) for m in group] for group in groups])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([host], pa.string()), pa.array([sorted(kept)], pa.list_(pa.int64()))], ["host", "template"]
                )

    return nested.mapInArrow(nest, "host string, template array<long>")


def nested_classes(classes: list[list[tuple[int, int, bool]]]) -> set[int]:
    """Tokens of the classes that nest in each other, from the document (0) down.

    A member is its token, the token that must hold it, and whether it is a text of an article: then its holder,
    the article, must be of the same class. A class with members that nothing holds is dropped as a whole.
    """
    open_ = []
    for group in classes:
        own = {token for token, _, _ in group}
        if all(parent in own for _, parent, inner in group if inner):
            open_.append((own, {parent for _, parent, _ in group} - own))
    # Holders form a tree, so what is left when nothing more must go hangs together from the document down.
    while True:
        kept = {0}.union(*(own for own, _ in open_))
        rest = [(own, needs) for own, needs in open_ if needs <= kept]
        if len(rest) == len(open_):
            return kept
        open_ = rest


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    path = fresh_path(spark, "templates")
    templates(pages).write.parquet(path)
    found = spark.read.schema("host string, template array<long>").parquet(path)
    size = found.agg(F.count("*"), F.coalesce(F.sum(F.size("template")), F.lit(0))).first()
    # Beyond the bound Spark shuffles, and splits a host that has too many pages.
    joined = _columns(pages).join(F.broadcast(found) if sum(size) <= BROADCAST_NUMBERS else found, "host", "left")

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, CHUNK, "html"):
            texts = [
                main_text(html, None if template is None else set(template))
                for html, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.select("page_id", "url", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
