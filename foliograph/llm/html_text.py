"""Main text of web pages by line-block distribution.

Markup is stripped to one line for each block; a line counts its letters outside links, in an ``article``
or ``main`` all its letters ``MARKED`` times, and nothing in a menu, header, footer, sidebar, notice, advert,
form or reader comment (told by element, role, or a class or id such as ``cookie-notice`` or
``ad-box``: see ``_named``). The counts are summed over sliding windows of ``WINDOW`` lines: text
surges where a sum rises above ``THRESHOLD`` and dives where it is back at 0 (where none rises above
it, above 0). The longest text between a surge and its dive is the core. Kept are the core, what lies
in its container however short (the innermost element of ``CONTAINERS`` with over half of it and two
lines of it, widened to the ``article`` or else the ``main`` around that), and every other text from a surge to a dive that counts at
least ``SHARE`` of the core. Lines that count nothing because all of it is links stay inside that
container only; those of menus and the like never stay.

Character references are decoded, white space in a block becomes one space, ``br`` is white space,
blocks are joined by a line feed; nothing else is dropped or capped. A page whose text is all in a
form is read again as if there were no forms. Null or empty html, and pages without text, give the
empty text. Repeated rows are extracted each. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from foliograph.llm.common import chunks

WINDOW, THRESHOLD, SHARE, MARKED = 3, 80, 0.2, 4
#: Elements by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center details div main section td".split())
RAW = frozenset("script style template noscript iframe object svg textarea select button title canvas audio video noframes".split())
CONTENT = frozenset(["article", "main"])
ASIDE = frozenset("nav header footer aside menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adbox adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pagination popup promo promoted related share sharing sidebar signup skyscraper social sponsor sponsored subscribe taboola toolbar widget".split()
)
COMMENTS = frozenset("comment comments commentlist disqus discussion replies respond".split())
#: Words that may follow a name in a class or id without changing what it names.
PARTS = frozenset(
    "area bar block body bottom box btn button buttons card cards col column container content embed feed form frame group holder icons image images inner item items label left count link links list message meta outer overlay panel reply right row section side slot slots space text thread top unit units wrap wrapper zone".split()
)
#: Words that mean no text of the article whatever follows them.
STARTS = frozenset("adsbygoogle breadcrumb breadcrumbs gdpr nav navbar outbrain sidebar skyscraper taboola".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
_MARKS = re.compile(r"""(?i)(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW | {"head"}}
_HEAD_END = re.compile(r"</head\b[^>]*>|<body\b", re.I)
#: A form may hold the whole page, so an article in it counts; nothing in what is beside the text or a comment does.
PLAIN, FORM, BESIDE, COMMENT, INSIDE = range(5)


def _named(value: str, names: frozenset[str]) -> bool:
    """Whether a class or id says that an element is one of the names: a token's last word is one (``site-header``), or
    its first with nothing but parts and numbers behind it (``ad-box-2``) or of a kind that nothing changes
    (``sidebar-widgets``); ``share-price`` says nothing of the kind."""
    for token in value.split():
        words = [w.lower() for w in _NAME.findall(token) if not w.isdigit()]
        if words and (words[-1] in names or words[0] in names and (words[0] in STARTS or PARTS.issuperset(words[1:]))):
            return True
    return False


def _part(tag: str, attributes: str) -> int:
    """The part that an element's own name and marks give it."""
    part = INSIDE if tag in CONTENT else FORM if tag == "form" else BESIDE if tag in ASIDE else PLAIN
    for kind, value in _MARKS.findall(attributes) if attributes else ():
        value = html.unescape(value.strip("\"'"))
        if kind.lower() == "role":
            part = max(part, BESIDE) if value.lower() in ROLES and part != INSIDE else INSIDE if value.lower() == "main" else part
            continue
        if _named(value, COMMENTS):
            return COMMENT
        if part != INSIDE and tag not in ("body", "html") and _named(value, NAMES):
            part = BESIDE
    return part


def lines_of(page: str, forms: bool = True) -> tuple[list[tuple[str, int, int]], list[tuple[int, str]]]:
    """(text, count, container) of each block in page order, with empty lines around what is left out; and of each
    container the one around it and its element."""
    out: list[tuple[str, int, int]] = []
    words: list[str] = []
    linked = 0
    links = 0
    stack: list[tuple[str, int, int]] = []  # open elements with the part and the container around them
    part = PLAIN
    around, container = [(0, "")], 0

    def end_line() -> None:
        nonlocal linked
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if text:
                count = MARKED * len(text) if part == INSIDE else max(0, len(text) - linked)
                out.append((text, count, container) if part in (PLAIN, INSIDE) else ("", 0, container))
        linked = 0

    def enter(new: int) -> int:
        if part in (BESIDE, COMMENT):
            return part
        if new == FORM:
            return FORM if forms and part != INSIDE else part if not forms else BESIDE
        return new if new != PLAIN else part

    def turn(to: int) -> None:
        nonlocal part
        if (part in (PLAIN, INSIDE)) != (to in (PLAIN, INSIDE)):
            out.extend([("", 0, container)] * WINDOW)
        part = to

    def text(run: str) -> None:
        nonlocal linked
        words.append(run)
        if links:
            linked += len(run.strip())

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag == "br":
            words.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "head" and not closing:
            end_line()
            # Without an end the first block ends it; what else it holds is in RAW.
            if e := _HEAD_END.search(page, at):
                at = e.start() if e[0].lower().startswith("<body") else e.end()
        elif tag in RAW:
            if not closing and not attributes.endswith("/"):
                e = _RAW_END[tag].search(page, at)
                at = e.end() if e else len(page)
            words.append(" ")
        elif tag in BLOCKS:
            end_line()
            links = 0
            if closing:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if depth is not None:
                    _, to, container = stack[depth]
                    del stack[depth:]
                    turn(to)
            elif tag not in VOID:
                if tag == "p" and stack and stack[-1][0] == "p":
                    turn(stack.pop()[1])
                stack.append((tag, part, container))
                if tag in CONTAINERS:
                    around.append((container, tag))
                    container = len(around) - 1
                turn(enter(_part(tag, attributes)))
        elif attributes and not closing and tag not in VOID and _part(tag, attributes) in (BESIDE, COMMENT):
            end_line()
            stack.append((tag, part, container))
            turn(enter(_part(tag, attributes)))
        elif closing and stack and stack[-1][0] == tag:
            end_line()
            turn(stack.pop()[1])
    text(page[at:])
    end_line()
    return out, around


def stretches(lengths: list[int], window: int, threshold: int) -> list[tuple[int, int]]:
    """From each surge of the window sums above the threshold to the dive back to 0."""
    sums, total = [], sum(lengths[:window])
    for i, n in enumerate(lengths):
        sums.append(total)
        total += (lengths[i + window] if i + window < len(lengths) else 0) - n
    found, start = [], None
    for i, s in enumerate(sums):
        if start is None and s > threshold:
            start = i
        elif start is not None and s == 0:
            found.append((start, i))
            start = None
    return found + [(start, len(lengths))] * (start is not None)


def container_of(lines: list[tuple[str, int, int]], around: list[tuple[int, str]], core: tuple[int, int]) -> int:
    """The innermost container with over half of the core (and two of its lines, if it has two), or the outermost article,
    else the ``main``, around that."""
    mass, counted = [0] * len(around), [0] * len(around)
    for _, n, c in lines[core[0] : core[1]]:
        mass[c] += n
        counted[c] += n > 0
    whole, several = sum(mass), min(2, sum(counted))
    for c in range(len(around) - 1, 0, -1):
        mass[around[c][0]] += mass[c]
        counted[around[c][0]] += counted[c]
    # More than half lies in a chain of containers only; the last to open is the innermost.
    chosen = c = max((c for c, n in enumerate(mass) if 2 * n > whole and counted[c] >= several), default=0)
    chain = []
    while c:
        chain.append(c)
        c = around[c][0]
    marked = [c for kind in ("article", "main") for c in chain if around[c][1] == kind]
    articles = [c for c in marked if around[c][1] == "article"]
    return (articles or marked or [chosen])[-1]


def kept_lines(lines: list[tuple[str, int, int]], around: list[tuple[int, str]]) -> list[str]:
    """The lines that the distribution of counts keeps."""
    counts = [n for _, n, _ in lines]
    mass = lambda s: sum(counts[s[0] : s[1]])
    found = stretches(counts, WINDOW, THRESHOLD) or stretches(counts, WINDOW, 0)
    if not found:
        return []
    core = max(found, key=mass)
    least = SHARE * mass(core)
    kept = {i for s in found if mass(s) >= least for i in range(*s)}
    inside = [False] * len(around)
    chosen = container_of(lines, around, core)
    for c in range(len(around)):
        inside[c] = c == chosen or (c > 0 and inside[around[c][0]])
    return [text for i, (text, _, c) in enumerate(lines) if text and (inside[c] or i in kept)]


def main_text(page: str | None) -> str:
    for forms in (True, False):
        kept = kept_lines(*lines_of(page or "", forms))
        if kept or "<form" not in (page or "").lower():
            break
    return "\n".join(kept)


def extract(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (code points) of every page."""
    df = pages.select(*keep, column)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != column) + ", text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column, 8 << 20):
                texts = [main_text(x) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return df.mapInArrow(run, ddl)
