"""Main-text extraction from HTML by two-pass block rules.

A page is cut into blocks at block-level tags, in one pass over its characters.
The first pass decides a block by its link density, its length and its density
of stop words, inside the article as elsewhere; what stands in a menu, footer,
form, comment section or the like is out by its place. The second lets the
ambiguous ones, short for the most part, inherit the label of the nearest
decided neighbours that don't stand in such a place.

Places: tags such as nav or aside, comment sections and hidden elements always
count. Other class, id and role names ("promo", "sidebar") count by whole tokens
or their hyphenated parts, unless negated ("has-sidebar", "ad-free"); an article
or main element inside cancels them, and so does, on a page without one, a name
that covers half of the page's prose. If an article or main element has half of
the prose, nothing outside it is kept but a heading right before.

Cases: null or empty html gives the empty text; a page without a decided block
keeps what doesn't stand in a menu, form or the like; unclosed scripts, comments
and tags end with the page; repeated rows are extracted row by row; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

# Elements of HTML by their role, and words that name parts of a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe canvas select title".split())
MAIN = frozenset(("article", "main"))
BOILERPLATE = frozenset("nav footer aside form menu dialog search".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: With one of these a name says something of comments, such as `comments-open`, and isn't theirs.
COMMENT_STATES = frozenset("open closed enabled disabled allowed on off count counter number link links status state".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager copyright disclaimer skip topbar masthead complementary contentinfo alert hidden".split()
)
NEGATIONS = frozenset("has no non not with without free is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STOP_WORDS = frozenset(
    "the of and to a in is it that for on with as was are be by this from or at an not but they he she you we have has had which will their its"
    " der die das und ist in den von zu mit sich des auf für nicht ein eine als auch dem im es an werden aus er hat dass sie nach wird bei"
    " le la les de des du un une et est en que qui dans pour pas sur au par plus avec ce il elle se ne son sa ou aux"
    " el los las del y que se por con para una su al lo como más pero sus ja si no".split()
)

_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_END = re.compile("[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_UNSEEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_WORD = re.compile(r"[^\W\d_]+")

#: Link density above which a block is a menu; characters from which a block is long; stop words' share that is prose; share of the prose that decides about names and articles.
MAX_LINKS = 0.5
LONG = 70
PROSE = 0.15
MOST = 0.5
GOOD, BAD, UNSURE = 1, 0, -1


@dataclass
class Block:
    """linked: characters in links; main: inside an article; out: in a place that always counts; named: elements around it whose names tell against it."""

    text: str
    linked: int
    main: bool
    out: bool
    named: tuple[int, ...]
    heading: bool


def _tags(page: str) -> Iterator[tuple[str, bool, str, int, int]]:
    """(name, closing, attributes, where the tag begins, where what follows it begins); comments and the like have no name. Every search goes forward only."""
    at, n = 0, len(page)
    dead: set[str] = set()  # quotes that don't occur any more
    raw_dead: set[str] = set()
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith(("<!--", "<![CDATA["), start):
            end = page.find(*(("-->", start + 4) if page[start + 2] == "-" else ("]]>", start + 9)))
            at = n if end < 0 else end + 3
            yield "", False, "", start, at
            continue
        m = _TAG.match(page, start + 1)
        if not m:
            if start + 1 < n and page[start + 1] in "!?/":
                end = page.find(">", start)
                at = n if end < 0 else end + 1
                yield "", False, "", start, at
            else:
                at = start + 1
            continue
        at = m.end()
        while True:
            q = _END.search(page, at)
            if q is None:
                yield "", False, "", start, n
                return
            at = q.end()
            if q[0] == ">":
                break
            if q[0] not in dead:
                end = page.find(q[0], at)
                if end < 0:
                    dead.add(q[0])
                else:
                    at = end + 1
        name, attributes = m[2].lower(), page[m.end() : at - 1]
        if name in RAW and not m[1]:
            end = None if name in raw_dead else re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            if end is None:
                raw_dead.add(name)
                at = n
            else:
                at = end.end()
            yield "", False, "", start, at
            continue
        yield name, bool(m[1]), attributes, start, at


def _bad_name(token: str) -> str | None:
    parts = {p.lower() for p in _PARTS.findall(token)} | {token.lower()}
    if parts & NEGATIONS:
        return None
    return "comments" if parts & COMMENTS and not parts & COMMENT_STATES else "named" if parts & BAD_NAMES else None


@dataclass
class _Open:
    """An open element and what it inherits: as in Block."""

    name: str
    main: bool
    out: bool
    named: tuple[int, ...]
    #: Out by nothing but a name of comments; the page's first article inside is in again.
    talk: bool = False


def blocks(page: str | None) -> list[Block]:
    """The blocks that have text, in page order."""
    out: list[Block] = []
    open_: list[_Open] = []
    counts: Counter[str] = Counter()
    root = _Open("", False, False, ())
    words: list[str] = []
    linked = elements = 0
    link = heading = seen = False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            top = open_[-1] if open_ else root
            out.append(Block(text, linked, top.main, top.out, top.named, heading))
        words.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            words.append(text)
            if link:
                linked += len(" ".join(text.split()))

    def close(k: int) -> None:
        for x in open_[k:]:
            counts[x.name] -= 1
        del open_[k:]

    at, page = 0, page or ""
    for name, closing, attributes, start, after in _tags(page):
        say(page[at:start])
        at = after
        if not name:
            continue
        if name == "br":
            words.append(" ")
        block = name in BLOCKS
        if name in ("a", "button"):
            link = not closing
        if block:
            flush()
            link = False
            heading = not closing and name in HEADINGS
        if closing:
            if counts[name]:
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k].name == name:
                        close(k)
                        break
                    if not block and open_[k].name in BLOCKS:
                        break
            continue
        if block:
            ends = {"p"} | ({name} if name in ("li", "td", "th", "tr", "dt", "dd") else set())
            if any(counts[x] for x in ends):
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k].name in ends:
                        close(k)
                        break
                    if open_[k].name in BLOCKS and open_[k].name not in HEADINGS:
                        break
        if name in VOID or attributes.endswith("/") and not block:
            continue
        top = open_[-1] if open_ else root
        found = {_bad_name(t) for m in _NAMES.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").split()} if attributes else set()
        tokens = {t.lower() for m in _NAMES.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").split()} if attributes else set()
        main = name in MAIN or name in ("div", "section") and "main" in tokens
        talk = "comments" in found and (seen or not main)
        gone = name in BOILERPLATE or bool(attributes) and bool(_UNSEEN.search(attributes)) or name == "header" and not top.main and not main
        if name in ("html", "body"):
            gone, talk, found = False, False, set()
        if main:
            named: tuple[int, ...] = ()
        elif "named" in found:
            elements += 1
            named = (*top.named[-31:], elements)
        else:
            named = top.named
        inside = top.out and not (main and not seen and top.talk)
        out_now = inside or gone or talk
        seen = seen or main and not out_now
        open_.append(_Open(name, top.main or main, out_now, named, out_now and not gone and (top.talk if inside else talk)))
        counts[name] += 1
    say(page[at:])
    flush()
    return out


def _prose(text: str) -> float:
    """The share of stop words."""
    found = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0


def first_pass(found: list[Block]) -> list[int]:
    """The label of each block by its place, links, length and stop words."""
    prose = [0.0 if b.out else _prose(b.text) for b in found]
    weight = [len(b.text) if not b.out and len(b.text) >= LONG and b.linked <= MAX_LINKS * len(b.text) else 0 for b in found]
    total = sum(weight)
    articles = any(b.main and not b.out for b in found)
    covered: Counter[int] = Counter()
    for b, w in zip(found, weight, strict=True):
        for e in b.named:
            covered[e] += w
    counting = {e for e, w in covered.items() if articles or w < MOST * total or not total}
    inside = articles and total > 0 and sum(w for b, w in zip(found, weight, strict=True) if b.main) >= MOST * total
    known = total > 0 and sum(w * p for w, p in zip(weight, prose, strict=True)) >= PROSE * total
    labels = []
    for k, (b, p) in enumerate(zip(found, prose, strict=True)):
        n, links = len(b.text), b.linked / len(b.text)
        if b.out or any(e in counting for e in b.named):
            labels.append(BAD)
        elif inside and not b.main and not (b.heading and k + 1 < len(found) and found[k + 1].main):
            labels.append(BAD)
        elif links > MAX_LINKS:
            labels.append(UNSURE if b.heading or n >= LONG and p >= PROSE else BAD)
        elif n < LONG:
            labels.append(UNSURE)
        elif p >= PROSE:
            labels.append(GOOD)
        else:
            labels.append(BAD if known and not b.main and p < PROSE / 3 and n < 3 * LONG else UNSURE)
    return labels


def _placed(b: Block) -> bool:
    """Whether the block's place tells against it."""
    return b.out or bool(b.named)


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    """Ambiguous blocks take the nearest decided neighbour's label, for which those whose place decided don't count. Of two as near, the good one wins inside an article; else headings look ahead and others back. Without neighbours they are good."""
    before: list[int | None] = []
    last = None
    for k, (b, label) in enumerate(zip(found, labels, strict=True)):
        before.append(last)
        if label != UNSURE and not (label == BAD and _placed(b)):
            last = k
    out, after = list(labels), None
    for k in range(len(found) - 1, -1, -1):
        b, p = found[k], before[k]
        if labels[k] == UNSURE:
            if p is None or after is None:
                near = after if p is None else p
                out[k] = GOOD if near is None or b.main else labels[near]
            elif b.main:
                # inside an article a block is bad only between bad ones
                out[k] = BAD if labels[p] == labels[after] == BAD else GOOD
            elif k - p < after - k or k - p == after - k and not b.heading:
                out[k] = labels[p]
            else:
                out[k] = labels[after]
        elif not (labels[k] == BAD and _placed(b)):
            after = k
    return out


def main_text(page: str | None) -> str:
    found = blocks(page)
    labels = second_pass(found, first_pass(found))
    return "\n".join(b.text for b, label in zip(found, labels, strict=True) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages."""
    small_batches(pages.sparkSession)
    out = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    ids = out.schema["page_id"].dataType.simpleString()
    return out.mapInArrow(run, f"page_id {ids}, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
