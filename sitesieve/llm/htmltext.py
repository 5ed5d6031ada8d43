"""Main text of web pages, with page differencing between nearest URLs.

A page is read into lines, one per block element. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments are known by their elements, roles and class names and give no lines; but an element that
holds the article is none of them, whatever its name. Pages of
a host are put in order of their URL path; each is paired with the neighbour whose path shares more with
its own. The lines of the two are aligned by their longest common subsequence, and shared lines go: they
are furniture of the site. Where a page marks its article (article, main), the article is the text and
its lines stay even if the neighbour has them too, since passages are shared by articles as well.

Rules for odd rows: a null page is the empty page; a null URL has no host and no path; pages that repeat an id
are told apart by URL and content, and repeated rows give repeated results; a page whose every line its
neighbour has (a copy) keeps its lines, one whose neighbour has most of its passages (a near copy) its passages; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import checked_broadcast, join_rows

# Fixed values of the HTML standard and of common page design.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object select noembed xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav aside footer form button menu dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Short texts beside the article, which may be marked as articles themselves.
TEASERS = (
    r"ads?|advert[^\W_]*|adsense|sponsor[^\W_]*|promo[^\W_]*|comments?|disqus|respond|related|recommended"
)
FRAMES = (
    r"banner|cookie[^\W_]*|consent|notice[^\W_]*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|"
    r"newsletter|subscribe|subscription|share|sharing|social|popup|modal|login|signup|search|widget|toolbar"
)
# Words that leave a furniture name what it is; with any other word ("has-sidebar", "page-header-layout") it is none.
QUALIFIERS = (
    r"site|page|main|top|bottom|primary|secondary|global|post|posts|entry|article|articles|wrap|wrapper|container|inner|area|box|bar|"
    r"block|list|links?|buttons?|icons?|items?|body|left|right|fixed|sticky|mobile|desktop|div|form|text|title|by|\d+"
)
WORD = re.compile(rf"(?:{TEASERS}|{FRAMES})", re.I)
NAMES = re.compile(
    rf"(?<!\S)(?:(?:{QUALIFIERS})[-_]+)*(?:{TEASERS}|{FRAMES})(?:[-_]+(?:{TEASERS}|{FRAMES}|{QUALIFIERS}))*(?!\S)", re.I
)
# Characters from which a line counts as a passage rather than as a label.
PASSAGE = 80
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?|\Z", re.I) for name in RAW}
# Those of them that may hold elements of their own name, and those that may close themselves.
NESTED = frozenset("template svg math canvas object".split())
FOREIGN = frozenset("svg math".split())
_RAW_TAG = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>|\Z", re.I) for name in NESTED}


def _after_raw(page: str, name: str, tag: str, at: int) -> int:
    """Where the page goes on after the element that `tag`, which ends at `at`, opens.

    Elements of its name inside it are counted; if not all of them end, the first end counts.
    """
    if name in FOREIGN and tag.endswith("/>"):
        return at
    first = _RAW_END[name].search(page, at).end()
    if name not in NESTED:
        return first
    depth = 1
    while depth:
        inner = _RAW_TAG[name].search(page, at)
        if inner[1] is None:
            return first
        at = inner.end()
        if inner[1]:
            depth -= 1
        elif not (name in FOREIGN and inner[0].endswith("/>")):
            depth += 1
    return at


def furniture_kind(name: str, attributes: str, in_article: bool) -> str:
    """Why an element belongs to the page's frame rather than to its text: `form`, `element` (or its role), `teaser`,
    `name` (a guess by class or id), or "" if it does not."""
    if name in FURNITURE or name == "header" and not in_article:
        return "form" if name == "form" else "element"
    if attributes and name not in ("html", "body"):
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            if key.lower() == "role":
                if value in ROLES:
                    return "form" if value == "form" else "element"
            elif names := NAMES.findall(value.replace("side-bar", "sidebar")):
                hits = [w for n in names for w in re.split("[-_]+", n) if WORD.fullmatch(w)]
                # an article's own header holds its title
                if in_article and all(h == "header" for h in hits):
                    continue
                if name in ("article", "main") and "comment" not in value:
                    return ""
                return "teaser" if any(re.fullmatch(TEASERS, h) for h in hits) else "name"
    return ""


def page_lines(page: str | None) -> list[tuple[str, bool]]:
    """The lines of a page in order, each with whether it stands in a marked article."""
    lines, frames, seen = _read(page or "", frozenset())
    if frames and (shown := shown_frames(frames, seen)):
        lines = _read(page, shown)[0]
    if frames and not lines:
        # all that only its name or a form hid
        lines = _read(page, frozenset(f[0] for f in frames if f[2] != "element"))[0]
    return lines


def shown_frames(frames: list[list], seen: list[int]) -> frozenset[int]:
    """Places of the furniture elements that are shown after all, since they hold the article or most of the page.

    `frames`: see _read. A main element is always shown, an article too, unless it is a teaser, or in an element for
    furniture, and more text than that stands elsewhere. A form is shown if it holds most of the page, and
    within an article whose every line would be hidden any guess is.
    """
    # text, main and article of the inner ones count for the outer ones as well; outer ones come first
    own = [sum(f[3]) for f in frames]
    text, main, article = own[:], [f[4] for f in frames], [f[5] for f in frames]
    for k in range(len(frames) - 1, -1, -1):
        if (outer := frames[k][1]) >= 0:
            text[outer] += text[k]
            main[outer] |= main[k]
            article[outer] |= article[k]
    whole = sum(seen) + sum(own)
    guess = [f[2] in ("form", "name") for f in frames]
    shown = [main[k] or article[k] and guess[k] or f[2] == "form" and 2 * text[k] > whole for k, f in enumerate(frames)]

    def visible() -> list[int]:
        got, reached = seen[:], []
        for k, f in enumerate(frames):
            reached.append(shown[k] and (f[1] < 0 or reached[f[1]]))
            if reached[k]:
                got = [got[0] + f[3][0], got[1] + f[3][1]]
        return got

    elsewhere = sum(visible())
    for k in range(len(frames)):
        shown[k] = shown[k] or article[k] and text[k] > elsewhere
    if not visible()[1]:
        shown = [shown[k] or guess[k] and f[6] for k, f in enumerate(frames)]
    return frozenset(f[0] for k, f in enumerate(frames) if shown[k])


def _read(page: str, shown: frozenset[int]) -> tuple[list[tuple[str, bool]], list[list], list[int]]:
    """Lines; furniture elements; and how much text stands outside them, first outside and then inside an article.

    A furniture element is [place, the one around it or -1, kind, its own text (as in `seen`), holds a main, holds an article, in an
    article]. Those at the places `shown` do not hide what is in them.
    """
    lines: list[tuple[str, bool]] = []
    frames: list[list] = []
    seen = [0, 0]
    pieces: list[str] = []
    # open elements: (name, hidden from here on, in an article from here on, furniture element or -1)
    stack: list[tuple[str, bool, bool, int]] = []
    hidden = marked = False
    frame = -1

    def end_line():
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                lines.append((text, marked))
            pieces.clear()

    def close(name):
        nonlocal hidden, marked, frame
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                del stack[k:]
                break
        hidden, marked, frame = stack[-1][1:] if stack else (False, False, -1)

    at = 0
    while True:
        token = TOKEN.search(page, at)
        piece = page[at : token.start() if token else len(page)]
        if not hidden:
            pieces.append(piece)
        if frame < 0:
            seen[marked] += len(piece.strip())
        else:
            frames[frame][3][marked] += len(piece.strip())
        if token is None:
            break
        at = token.end()
        if token[2] is None:
            continue
        name = token[2].lower()
        if name in BLOCKS:
            end_line()
        elif name == "br":
            pieces.append(" ")
        if token[1]:
            close(name)
        elif name in RAW:
            at = _after_raw(page, name, token[0], at)
        elif name not in VOID:
            if name in BLOCKS and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
                close(stack[-1][0])
            kind = furniture_kind(name, token[3], marked)
            if kind:
                frames.append([token.start(), frame, kind, [0, 0], False, False, marked])
                frame = len(frames) - 1
            elif frame >= 0 and name in ("article", "main"):
                frames[frame][4 if name == "main" else 5] = True
            stack.append((name, hidden or bool(kind) and token.start() not in shown, marked or name in ("article", "main"), frame))
            hidden, marked, frame = stack[-1][1:]
    end_line()
    return lines, frames, seen


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in `a` of a longest common subsequence with `b`, by bit-parallel dynamic programming."""
    both = set(a) & set(b)
    left, right = [k for k, x in enumerate(a) if x in both], [x for x in b if x in both]
    masks: dict[int, int] = {}
    for j, x in enumerate(right):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(right)) - 1
    row, rows = full, [full]
    for k in left:
        hit = row & masks[a[k]]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    # a zero bit marks where the length grows; walk back from the end
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    i, j, out = len(left), len(right), []
    while i and j:
        if a[left[i - 1]] == right[j - 1]:
            i, j = i - 1, j - 1
            out.append(left[i])
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return out[::-1]


def main_text(lines: list[tuple[str, bool]], shared=()) -> str:
    """The marked lines, or else those that the neighbour does not share.

    A neighbour that shares most of the text in passages is a near copy, and passages it shares are no furniture.
    """
    if any(marked for _, marked in lines):
        return "\n".join(text for text, marked in lines if marked)
    gone = set(shared)
    passages = {k: len(text) for k, (text, _) in enumerate(lines) if len(text) >= PASSAGE}
    if 2 * sum(n for k, n in passages.items() if k in gone) > sum(passages.values()):
        gone -= passages.keys()
    kept = [text for k, (text, _) in enumerate(lines) if k not in gone]
    return "\n".join(kept or [text for text, _ in lines])


def _outline(batches):
    """Hashes of a page's lines, and whether its article is unmarked."""
    import xxhash

    for batch in batches:
        hashes, free = [], []
        for page in batch.column(4).to_pylist():
            lines = page_lines(page)
            hashes.append([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in lines])
            free.append(not any(m for _, m in lines))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(hashes, pa.list_(pa.int64())), pa.array(free, pa.bool_())],
            [*batch.schema.names[:4], "lines", "free"],
        )


def _align(batches):
    """Places of the lines that a page shares with the nearer of its neighbours."""
    for batch in batches:
        rows = batch.select([2, 3, 4]).to_pylist()
        shared = [common_lines(r["lines"], r["other"] or []) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(shared, pa.list_(pa.int32())), batch.column(4)], ["page_id", "row_key", "shared", "free"]
        )


def _extract(batches):
    for batch in batches:
        pages, shared = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        texts = [main_text(page_lines(p), s or ()) for p, s in zip(pages, shared)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def row_key() -> Column:
    return F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))


def nearest_pages(outlines: DataFrame) -> DataFrame:
    """(page_id, row_key, lines, other, free): each page with the lines of its nearest page on the host.

    Neighbours are found by rank in the sorted table, so a host with very many pages is no task of its own.
    """
    order = ["host", "path", "page_id", "row_key"]
    rows = cut_lineage(outlines.sort(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    # one row per sorted partition: how many rows stand before it
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.broadcast(sizes.select("part", F.expr("sum(n) over (order by part) - n").alias("before")))
    ranked = rows.withColumn("part", part).join(before, "part").withColumn(
        "rank", F.col("before") + F.col("place") - F.shiftleft("part", 33)
    ).drop("part", "before", "place")
    ranked = cut_lineage(ranked)
    beside = ranked.select("rank", F.col("host").alias("h"), F.col("path").alias("p"), F.col("lines").alias("l"))
    for name, step in (("a", 1), ("b", -1)):
        side = beside.select((F.col("rank") + step).alias("rank"), *[F.col(c).alias(f"{name}_{c}") for c in "hpl"])
        ranked = ranked.join(side, "rank", "left")
    same = lambda n: F.col(f"{n}_h").eqNullSafe(F.col("host"))
    # the common start of two paths, by comparing prefixes of every length up to 64 segments' worth of text
    share = lambda n: shared_prefix(F.col("path"), F.col(f"{n}_p"))
    other = F.when(same("a") & (~F.coalesce(same("b"), F.lit(False)) | (share("a") >= share("b"))), F.col("a_l")).when(same("b"), F.col("b_l"))
    return ranked.select("page_id", "row_key", "lines", other.alias("other"), "free")


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading path segments that two paths have in common, in halves: equal last segments count more."""
    left, right = F.split(F.coalesce(a, F.lit("")), "/"), F.split(F.coalesce(b, F.lit("")), "/")
    pairs = F.zip_with(left, right, lambda x, y: x.eqNullSafe(y))
    first_gap = F.array_position(pairs, F.lit(False))
    return F.when(first_gap == 0, F.size(pairs)).otherwise(first_gap - 1)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) per row of `pages` (`page_id`, `url`, `html`)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host")
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path")
    keyed = pages.select("page_id", row_key().alias("row_key"), host, path, "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    outlines = keyed.mapInArrow(
        _outline, f"page_id {kind}, row_key bigint, host string, path string, lines array<bigint>, free boolean"
    )
    aligned = nearest_pages(outlines).mapInArrow(
        _align, f"page_id {kind}, row_key bigint, shared array<int>, free boolean"
    )
    # only pages without a marked article lose lines
    gone = cut_lineage(aligned.filter("free and size(shared) > 0").select("page_id", "row_key", "shared").distinct())
    whole = pages.select("page_id", "url", "html", row_key().alias("row_key"))
    met = join_rows(whole, checked_broadcast(gone), "left", ("page_id", "row_key"))
    return met.select("page_id", "url", "html", "shared").mapInArrow(_extract, f"page_id {kind}, url string, text string")
