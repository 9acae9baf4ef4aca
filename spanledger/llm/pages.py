"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page's events into lines, one for each block of text. A line's ratio is its
characters by the tags met since the line before; lines inside elements that are never an article (menus, scripts ...; by
tag, role, class or id) have ratio 0. A form, or a name like `sidebar`, doesn't settle that by itself: an element that holds most of the page's
prose wraps the page, and a paragraph of an article is prose by its own ratio. The ratios, in page order, are smoothed by a Gaussian,
two-means clustering of the smoothed ratios gives a threshold, and regions (the landmarks article and main, or
else the enclosing containers) whose text lies above it on average are content. All other lines of a
content region stay, however short they are.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SIGMA = 1.0
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never the article's.
NOISE_TAGS = frozenset("aside button canvas datalist dialog footer form head iframe input label math menu nav noscript object option script search select style svg template textarea title".split())
#: Words in a class or id that mark an element as noise.
NOISE_WORDS = frozenset("ad ads advert adverts advertisement banner billboard breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus dropdown feedback footer gdpr hidden legal login masthead menu modal nav navbar navigation navigator newsletter notice notices notification outbrain pagination paywall popup promo promoted promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split())
#: Of these, those that mark what readers or third parties wrote, whatever its form is.
FOREIGN_WORDS = frozenset("ad ads advert adverts advertisement comment comments consent cookie cookies disqus gdpr newsletter outbrain promoted replies respond sponsor sponsored taboola".split())
#: Words before a noise word that say how a page is laid out (`no-sidebar`).
LAYOUT_WORDS = frozenset("has hide no show with without".split())
#: Code points of a line from which on it is prose, and by tags of a paragraph whose name alone speaks against it.
PROSE = 60
#: ARIA roles of noise.
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
LANDMARKS = frozenset(("article", "main"))
_CONTAINERS = frozenset("body div section td li blockquote table".split())
#: For an element that starts, the open elements of which it ends the innermost.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class LineParser(HTMLParser):
    """Turns events into lines of (pieces, tags, region, noise). A piece is a text and the doubtful elements it is in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, tuple[int, ...]]], int, int, bool]] = []
        self.landmarks: set[int] = set()
        self.paragraphs: set[int] = set()  # doubtful elements that are paragraphs of an article
        self._open: list[tuple[str, bool, int, tuple[int, ...]]] = []  # tag, noise, region, doubtful elements
        self._text: list[tuple[str, tuple[int, ...]]] = []
        self._where = 0  # region of the text
        self._aside = False  # whether noise text was met since the last line
        self._tags = 0
        self._regions = 0
        self._doubts = 0

    def _state(self) -> tuple[bool, int, tuple[int, ...]]:
        return self._open[-1][1:] if self._open else (False, 0, ())

    def _flush(self) -> None:
        text = any(x.strip() for x, _ in self._text)
        aside, pieces, self._text, self._aside = self._aside, self._text, [], False
        if text or aside:  # noise lines only count for their place in the page
            self.lines.append((pieces if text else [], self._tags, self._where if text else self._state()[1], not text))
            self._tags = 0

    def _break(self, noise: bool) -> None:
        """A block begins or ends; one inside an inline noise element doesn't part the article's text around that."""
        if not noise or not any(x.strip() for x, _ in self._text):
            self._flush()

    def _noise(self, tag: str, attrs: dict, inside: bool) -> tuple[bool, bool]:
        """Whether an element is noise, or else doubtful."""
        if tag in ("html", "body"):
            return False, False
        if tag in NOISE_TAGS - {"form"} or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in NOISE_ROLES:
            return True, False
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.IGNORECASE):
            return True, False
        found: set[str] = set()
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
            words = _WORDS.findall(_CAMEL.sub(" ", name).lower())
            if words and words[0] not in LAYOUT_WORDS:
                found.update(words)
        if tag in LANDMARKS:  # a comment may be marked up as an article
            return inside and not FOREIGN_WORDS.isdisjoint(found), False
        return not FOREIGN_WORDS.isdisjoint(found), tag == "form" or not NOISE_WORDS.isdisjoint(found)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        first = tag in LANDMARKS and not self.landmarks
        if tag in BLOCK:
            self._break(self._state()[0] and not first)
        self._tags += 1
        if tag in VOID:
            if tag == "br":
                self._text.append((" ", ()))
            return
        if first:  # the first landmark isn't inside a noise element; that one lacks its end tag
            while self._open and (self._open[-1][1] or self._open[-1][3]) and self._open[-1][0] not in ("template", "noscript"):
                self._open.pop()
        elif tag in BLOCK and tag not in LANDMARKS:
            self._end_open(_CLOSES.get(tag, ("p",)), until=_CONTAINERS | LANDMARKS | {"ul", "ol", "dl"} if tag not in _CLOSES else {"ul", "ol", "dl", "table", "select"})
        noise, region, doubts = self._state()
        inside = region in self.landmarks
        own, doubtful = (False, False) if noise else self._noise(tag, dict(attrs), bool(self.landmarks))
        if tag == "header":  # the header of an article may hold its title
            own, doubtful = not inside, False
        noise = noise or own
        if tag in LANDMARKS and not inside and not noise:
            self._regions += 1
            region = self._regions
            self.landmarks.add(region)
        elif tag in _CONTAINERS and not inside:
            self._regions += 1
            region = self._regions
        if doubtful:
            self._doubts += 1
            doubts = (*doubts, self._doubts)
            if inside and tag in ("p", "section", "blockquote"):
                self.paragraphs.add(self._doubts)
        self._open.append((tag, noise, region, doubts))

    def _end_open(self, tags: tuple[str, ...], until: frozenset | set) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] in tags:
                del self._open[i:]
                return
            if self._open[i][0] in until:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._break(next((noise or bool(doubts) for name, noise, _, doubts in reversed(self._open) if name == tag), False) and tag not in ("form", "p", "section"))
        self._tags += 1
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                del self._open[i:]
                return
            if self._open[i][0] in BLOCK and tag not in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        noise, region, doubts = self._state()
        if not data or data.isspace():
            if not noise:
                self._text.append((data, doubts))
        elif noise:
            self._aside = True
        else:
            self._text.append((data, doubts))
            self._where = region

    def close(self) -> None:
        super().close()
        self._flush()


    def resolved(self) -> list[tuple[str, int, int, bool]]:
        """Lines of (text, tags, region, noise) once it is known which of the doubtful elements are noise.

        An element that holds more than half of the prose of the page wraps it. A paragraph of an article is content if each of its lines is prose.
        """
        prose, total, short = dict.fromkeys(range(1, self._doubts + 1), 0), 0, set()
        for pieces, tags, *_ in self.lines:
            whole = "".join(x for x, _ in pieces).strip()
            if len(whole) < PROSE:
                short.update(i for x, ids in pieces if x.strip() for i in ids)
                continue
            total += len(whole)
            for i in {i for _, ids in pieces for i in ids}:
                prose[i] += sum(len(x) for x, ids in pieces if i in ids)
        kept = {i for i, n in prose.items() if 2 * n > total or n and i in self.paragraphs and i not in short}
        out = []
        for pieces, tags, region, noise in self.lines:
            text = " ".join("".join(x for x, ids in pieces if kept.issuperset(ids)).split())
            out.append((text, tags, region, noise or not text))
        return out


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Convolution with a normalised Gaussian kernel; beyond the ends there is nothing."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    total = sum(kernel)
    padded = [0.0] * reach + values + [0.0] * reach
    return [sum(k * padded[i + j] for j, k in enumerate(kernel)) / total for i in range(len(values))]


def two_means(values: list[float]) -> float:
    """The threshold between the two clusters of the values."""
    lo, hi = min(values), max(values)
    for _ in range(20):
        cut = (lo + hi) / 2
        low, high = [v for v in values if v < cut], [v for v in values if v >= cut]
        new = (sum(low) / len(low) if low else lo, sum(high) / len(high) if high else hi)
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def main_text(html: str | None) -> str:
    """The main text of one page, its blocks joined by line ends; empty for a null, an empty page or one without content."""
    if not html:
        return ""
    parser = LineParser()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # a malformed declaration
        parser = LineParser()
        parser.feed(html.replace("<![", "&lt;!["))
        parser.close()
    lines = parser.resolved()
    if not any(not noise for *_, noise in lines):
        return ""
    smooth = smoothed([0.0 if noise else len(text) / max(1, tags) for text, tags, _, noise in lines])
    cut = two_means(smooth)
    weight: dict[int, list[float]] = {}
    for (text, _, region, noise), s in zip(lines, smooth):
        if not noise:
            sums = weight.setdefault(region, [0.0, 0.0])
            sums[0] += s * len(text)
            sums[1] += len(text)
    best = max(s / n for s, n in weight.values())
    content = {r for r, (s, n) in weight.items() if s / n >= min(cut, best)}
    marked = parser.landmarks & set(weight)
    if marked:  # a landmark with text is the article, whatever else is long
        content = (content & marked) or {max(marked, key=lambda r: weight[r][1])}
    return "\n".join(text for text, _, region, noise in lines if not noise and region in content)


def extract(pages: DataFrame) -> DataFrame:
    """The main text of each row of pages(page_id, url, html): page_id, url, text, n_chars (code points).

    A null html gives an empty text; null ids and URLs and repeated rows stay; other columns are ignored; an
    empty table gives no rows. A page is handled whole, one at a time.
    """

    def run(batches):
        for part in slices(batches, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
