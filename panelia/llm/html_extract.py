"""Operator 3, main text of HTML pages by wrapper induction over the pages of a host."""

import html as entities
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.llm.common import join_groups, stored, table

#: Comment, CDATA, declaration, end tag, start tag with balanced quotes, or else up to the next >.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([A-Za-z][^\s/>]*)[^>]*>"
    r"|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>)",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# The HTML elements of each kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
HOLDERS = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"),
    "td": ("tr",), "th": ("tr",), "option": ("select",),
}
P_HOLDERS = ("table", "td", "th", "li", "article", "div", "section")
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: Siblings of these tags are items of one list: however many there are, they count as one node.
ITEMS = TEXT_TAGS | frozenset("li dt dd tr td th option figure".split())
GENERIC = frozenset("div section".split())
DROPPED = frozenset(
    "nav footer aside form button select input dialog menu svg canvas object audio video head".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split()
)
#: Whole class or id tokens of reader comments, which vary and hold text as an article does. They
#: count outside article elements only.
COMMENTS = frozenset(
    "comments comment-list comment_list commentlist comments-area comment-section respond disqus_thread replies".split()
)
#: Whole class or id tokens that say advert, notice, menu and so on. They count for lists of links,
#: for text that a template repeats within articles, and, on a page that is judged alone, outside
#: article elements for what holds less than half of its text.
FURNITURE = frozenset(
    "ad ads advert advertisement banner sponsored promo cookie cookies cookie-banner consent gdpr notice popup modal "
    "newsletter subscribe signup login sidebar menu navbar nav navigation breadcrumb breadcrumbs pagination header "
    "footer masthead share sharing social related recommended widget toolbar skip-link".split()
)

#: Pages of a host (those of least hash) whose trees are merged into its wrapper.
PIVOTS = 4
#: A slot beside different main texts is template if it has one value only, or at most one for
#: each 1 / POOL of those main texts.
POOL = 0.05
#: With fewer main texts adverts of a pool still look like content, so class tokens help.
LEAST = 5
#: The wrapper descends into the child that holds this share of the varying text.
SHARE = 0.8
#: A slot whose text is links to this share may be a menu.
LINKS = 0.8
LISTS = frozenset("ul ol dl".split())
#: More children of a node are grouped by tag and class, then by tag, wherever they stand.
WIDE = 48
#: A run of more siblings that look the same is one node, whatever their tag.
RUN = 8
#: Wrappers of up to so many bytes for all hosts are broadcast; beyond, they are joined.
BROADCAST_BYTES = 32 << 20

PATH, CONTENT, FIXED, OUT = range(4)


# --- pages ---------------------------------------------------------------------------------------


class Node:
    __slots__ = ("tag", "marks", "dropped", "in_article", "in_main", "parent", "children", "pieces", "links")

    def __init__(self, tag, marks, dropped, parent):
        self.tag, self.marks, self.dropped, self.parent = tag, marks, dropped, parent
        self.in_article = tag == "article" or parent is not None and parent.in_article
        self.in_main = self.in_article or tag == "main" or parent is not None and parent.in_main
        self.children: list[Node] = []
        self.pieces: list = []  # text pieces and child nodes in page order
        self.links = 0  # characters of its own text that are links


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(source)}


def says_no_text(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    """Elements that by HTML's own word are no article: by tag, role, or because they are hidden."""
    if tag in DROPPED or (tag == "header" and not in_main):
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")))


def marks_of(attrs: dict[str, str]) -> frozenset:
    """Class and id tokens, with numbers as 0: post-17 and post-18 are one mark."""
    names = attrs.get("class", "") + " " + attrs.get("id", "")
    return frozenset(re.sub("[0-9]+", "0", names).lower().split()) if names != " " else frozenset()


def parse(page: str) -> Node:
    """The DOM of a page, lenient as browsers are about end tags; inline elements dissolve into
    the text of their block."""
    root = Node("#page", frozenset(), False, None)
    at, place, in_link = root, 0, False
    end = page.rfind(">") + 1  # no tag begins after it
    opened: dict[str, int] = {}

    def text(source: str):
        if source:
            at.pieces.append(entities.unescape(source) if "&" in source else source)
            if in_link:
                at.links += len("".join(source.split()))

    def close(names, until=()):
        """Leave the innermost open element of these names, if there is one before ``until``."""
        nonlocal at, in_link
        if not any(map(opened.get, names)):
            return
        node, left = at, []
        while node.tag not in names:
            if node.tag in until:
                return
            left.append(node.tag)
            node = node.parent
        for tag in (*left, node.tag):
            opened[tag] -= 1
        at, in_link = node.parent, False

    while place < end:
        m = TOKEN.search(page, place, end)
        if not m:
            break
        text(page[place : m.start()])
        place = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "a":
                in_link = False
            elif tag not in INLINE and tag != "br":
                close((tag,))
        elif m[2]:
            tag, rest = m[2].lower(), m[3][:-1]
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, place)
                place = stop.end() if stop else len(page)
                continue
            if tag == "br":
                at.pieces.append(" ")
                continue
            in_link = in_link or tag == "a"
            attrs = attributes(rest) if rest.strip(" /") else {}
            if tag in VOID or tag in INLINE and not attrs:
                continue
            dropped = says_no_text(tag, attrs, at.in_main)
            if tag in INLINE and not dropped:
                continue
            if tag in ENDS_P:
                close(("p",), until=P_HOLDERS)
            if tag in SIBLINGS:
                close(SIBLINGS[tag], until=HOLDERS[tag])
            node = Node(tag, marks_of(attrs), dropped, at)
            at.children.append(node)
            at.pieces.append(node)
            if not rest.rstrip().endswith("/"):
                at = node
                opened[tag] = opened.get(tag, 0) + 1
    text(page[place:])
    return root


def joined(pieces: list) -> str:
    return " ".join("".join(pieces).split())


def blocks(root: Node, verdict: dict[int, int] | None = None) -> list[str]:
    """Texts of the content blocks of a page in page order; without verdicts all that is not
    dropped. A node without a verdict goes with its parent (see ``states``)."""
    out, run = [], []
    stack: list = [(root, CONTENT if verdict is None else PATH)]
    while stack:
        piece, state = stack.pop()
        if isinstance(piece, str):
            if state == CONTENT:
                run.append(piece)
            continue
        if run:  # every node begins and ends a block
            out.append(joined(run))
            run.clear()
        if piece is None or piece.dropped:
            continue
        state = inherited(piece, state) if verdict is None else verdict.get(id(piece), inherited(piece, state))
        stack.append((None, state))
        stack.extend([(p, state) for p in reversed(piece.pieces)])
    out.append(joined(run))
    return [x for x in out if x]


def inherited(node: Node, state: int) -> int:
    """What a node without a counterpart in the wrapper is: within the article it is content;
    beside it only text blocks are."""
    if state == PATH and node.parent is not None:
        return CONTENT if node.tag in TEXT_TAGS else OUT
    return CONTENT if state == FIXED else state


# --- folded trees and their alignment ------------------------------------------------------------


class Slot:
    """A node of a folded tree: siblings that are items of one list, or one element."""

    __slots__ = ("tag", "marks", "children", "members", "text", "links", "in_article", "number", "shape")

    def __init__(self, tag, marks, in_article, members=()):
        self.tag, self.marks, self.in_article, self.members = tag, marks, in_article, members
        self.children: list[Slot] = []
        self.text, self.links, self.number, self.shape = "", 0, 0, 0


def grouped(nodes: list[Node]) -> list[list[Node]]:
    runs: list[list[Node]] = []
    for n in nodes:
        if runs and (runs[-1][0].tag, runs[-1][0].marks) == (n.tag, n.marks):
            runs[-1].append(n)
        else:
            runs.append([n])
    out = []
    for run in runs:
        out += [run] if run[0].tag in ITEMS or len(run) > RUN else [[n] for n in run]
    for key in (lambda n: (n.tag, n.marks), lambda n: n.tag):
        if len(out) > WIDE:
            held: dict = {}
            for run in out:
                held.setdefault(key(run[0]), []).extend(run)
            out = list(held.values())
    return out


def folded(root: Node) -> list[Slot]:
    """The folded tree of a page in page order, its root first."""
    top = Slot(root.tag, root.marks, False, [root])
    order, stack = [], [top]
    while stack:
        slot = stack.pop()
        slot.number = len(order)
        order.append(slot)
        below, own = [], []
        for n in slot.members:
            own += [p for p in n.pieces if isinstance(p, str)]
            own.append(" ")
            below += [c for c in n.children if not c.dropped]
            slot.links += n.links
        slot.text = joined(own)
        for run in grouped(below):
            slot.children.append(Slot(run[0].tag, run[0].marks, run[0].in_article, run))
        stack.extend(reversed(slot.children))
    return order


def shaped(order: list[Slot], known: dict) -> None:
    """Number the shapes: equal numbers are equal trees of tags and marks."""
    for slot in reversed(order):
        slot.shape = known.setdefault((slot.tag, slot.marks, tuple([c.shape for c in slot.children])), len(known))


def alike(a: Slot, b: Slot) -> int:
    """Weight of a pair: 0 if the two cannot be the same element of the template."""
    if a.tag != b.tag:
        return 0
    if a.marks == b.marks:
        return 2
    return 0 if a.tag in GENERIC and a.marks.isdisjoint(b.marks) else 1


def chain(xs: list[Slot], ys: list[Slot], sizes: dict) -> tuple[int, list[tuple[Slot, Slot]]]:
    """The heaviest pairs between two lists of siblings that keep their order."""
    if len(xs) == len(ys) and [x.shape for x in xs] == [y.shape for y in ys]:
        return sum([sizes[x.shape, y.shape] for x, y in zip(xs, ys)]), list(zip(xs, ys))
    best = [[0] * (len(ys) + 1)]
    for x in xs:
        before, row = best[-1], [0]
        for j, y in enumerate(ys):
            both = sizes.get((x.shape, y.shape), 0)
            row.append(max(before[j + 1], row[j], before[j] + both if both else 0))
        best.append(row)
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((xs[i], ys[j]))
    return best[-1][-1], pairs[::-1]


def matching(a: Slot, b: Slot, sizes: dict | None = None) -> int:
    """Simple tree matching: the greatest weight of pairs that keep order and ancestry. ``sizes``
    takes the weight of each pair of shapes that was compared."""
    sizes = {} if sizes is None else sizes
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        key = (x.shape, y.shape)
        if key not in sizes:
            own = alike(x, y)
            need = []
            if own:
                for c in x.children:
                    for d in y.children:
                        if (c.shape, d.shape) not in sizes:
                            if c.tag != d.tag:
                                sizes[c.shape, d.shape] = 0
                            else:
                                need.append((c, d))
            if need:
                stack.extend(need)
                continue
            sizes[key] = own and own + chain(x.children, y.children, sizes)[0]
        stack.pop()
    return sizes[a.shape, b.shape]


def aligned(page: list[Slot], wrapper: list[Slot]) -> list[tuple[Slot, Slot]]:
    """Pairs of a simple tree matching between a page and a wrapper."""
    known: dict = {}
    shaped(page, known)
    shaped(wrapper, known)
    sizes: dict = {}
    if not matching(page[0], wrapper[0], sizes):
        return []
    out, at = [(page[0], wrapper[0])], 0
    while at < len(out):
        x, y = out[at]
        if x.shape != y.shape:
            out += chain(x.children, y.children, sizes)[1]
        else:
            out += zip(x.children, y.children)
        at += 1
    return out


def numbered(root: Slot) -> list[Slot]:
    order, stack = [], [root]
    while stack:
        slot = stack.pop()
        slot.number = len(order)
        order.append(slot)
        stack.extend(reversed(slot.children))
    return order


def merged(trees: list[list[Slot]]) -> list[Slot]:
    """One tree with the nodes of all: what has no counterpart goes behind the sibling before it."""
    base = trees[0]
    for tree in trees[1:]:
        mate = {id(x): y for x, y in aligned(tree, base)}
        for x in tree:
            y = mate.get(id(x))
            if y is None:
                continue
            place = 0
            for child in x.children:
                other = mate.get(id(child))
                if other is not None:
                    place = next(k for k, c in enumerate(y.children) if c is other) + 1
                else:
                    y.children.insert(place, child)
                    place += 1
        base = numbered(base[0])
    return base


def written(order: list[Slot], flags: list[int] | None = None, top: int = -1) -> str:
    """A wrapper as JSON: a flat list in page order, since a tree may be deep."""
    parent = {id(c): s.number for s in order for c in s.children}
    rows = [[s.tag, sorted(s.marks), parent.get(id(s), -1), int(s.in_article)] for s in order]
    return json.dumps([rows, flags or [], top])


def read(source: str) -> tuple[list[Slot], list[int], int]:
    rows, flags, top = json.loads(source)
    order: list[Slot] = []
    for tag, marks, parent, in_article in rows:
        slot = Slot(tag, frozenset(marks), bool(in_article))
        slot.number = len(order)
        order.append(slot)
        if parent >= 0:
            order[parent].children.append(slot)
    return order, flags, top


# --- verdicts ------------------------------------------------------------------------------------


def verdicts(order: list[Slot], sums: dict[int, tuple], induced: bool) -> tuple[list[int], int]:
    """PATH, CONTENT, FIXED or OUT for every slot of a wrapper, and the slot of the article.

    ``sums`` holds for a slot (characters, those in links, values, main texts beside them) over
    all pages. A slot whose values are few beside many main texts is fixed: the template repeats
    it or draws it from a small set. From the root the wrapper descends into the child that holds
    nearly all of the varying text outside links, not beyond an article element. What stands there
    is CONTENT, what stands beside the way there is OUT, save text blocks, which may be a title or
    a lead. Fixed slots there are FIXED; but within an article element a heading, paragraph, list
    item or table cell that stands beside varying text belongs to it ("Summary", "Details").

    A list of links there is a menu if it is fixed, or if its class says so. With few main texts
    (``induced`` is false) little can be seen to vary or not: a list of links is then a menu unless
    it follows text as its sibling, and whole class tokens that say furniture count for all that
    holds less than half of the text, or stands beside an article or main element.
    """
    count = len(order)
    fixed, mass, links, chars, varying = [False] * count, [0] * count, [0] * count, [0] * count, [0] * count
    for s in order:
        size, linked, values, mains = sums.get(s.number, (0, 0, 0, 0))
        fixed[s.number] = mains > 1 and values <= max(1, POOL * mains)
        chars[s.number], links[s.number] = size, linked
        mass[s.number] = 0 if fixed[s.number] else size - linked
        varying[s.number] = 0 if fixed[s.number] else size
    hinted = [not s.in_article and s.tag not in ("html", "body", "main") and not s.marks.isdisjoint(COMMENTS) for s in order]
    if not induced:
        whole = list(chars)
        for s in reversed(order):
            whole[s.number] += sum([whole[c.number] for c in s.children])
        named = any(s.in_article or s.tag == "main" for s in order)
        for s in order:
            small = named or 2 * whole[s.number] < whole[0]
            if small and not s.in_article and s.tag not in ("html", "body", "main") and not s.marks.isdisjoint(FURNITURE):
                hinted[s.number] = True
    for s in reversed(order):
        for c in s.children:
            if not hinted[c.number]:
                for total in (mass, links, chars, varying):
                    total[s.number] += total[c.number]

    def linked(s: Slot) -> bool:
        return links[s.number] >= LINKS * chars[s.number] > 0

    def is_menu(s: Slot, text_before: bool) -> bool:
        if s.in_article or not linked(s):
            return False
        if not s.marks.isdisjoint(FURNITURE):
            return True
        if induced:
            return not varying[s.number]
        return not (text_before and (s.tag in LISTS or s.tag in TEXT_TAGS))

    def belongs(s: Slot, parent: Slot) -> bool:
        """A fixed slot that is part of an article."""
        return s.in_article and s.tag in ITEMS and varying[parent.number] > 0 and not linked(s) and s.marks.isdisjoint(FURNITURE)

    flags = [OUT] * count
    at = order[0]
    while at.tag != "article" and at.tag not in TEXT_TAGS:
        flags[at.number] = PATH
        inner = [c for c in at.children if not hinted[c.number] and c.tag not in ITEMS]
        child = max(inner, key=lambda c: mass[c.number], default=None)
        for c in at.children:
            if c.tag in TEXT_TAGS and not fixed[c.number] and not linked(c):
                flags[c.number] = CONTENT
        if child is None or mass[child.number] == 0 or mass[child.number] < SHARE * mass[at.number]:
            break
        at = child
    stack = [(at, False)]
    while stack:
        s, part = stack.pop()
        flags[s.number] = FIXED if fixed[s.number] and not part else CONTENT
        text_before = False
        for c in s.children:
            if not hinted[c.number] and not is_menu(c, text_before):
                stack.append((c, belongs(c, s)))
            text_before = text_before or c.tag in TEXT_TAGS and not linked(c)
    return flags, at.number


def text_sums(page: list[Slot]) -> dict[int, tuple]:
    return {s.number: (len(s.text), s.links, 1, 1) for s in page if s.text}


def main_text(root: Node, wrapper: tuple[list[Slot], list[int], int] | None = None) -> str:
    """Content of a page by the wrapper of its host. Without one, or if the page has no element
    for the article of the wrapper, the page is judged alone."""
    page = folded(root)
    flags = pairs = None
    if wrapper and wrapper[1]:
        order, flags, top = wrapper
        pairs = aligned(page, order)
        if all(y.number != top for _, y in pairs):
            flags = None
    if flags is None:
        flags, _ = verdicts(page, text_sums(page), False)
        pairs = [(s, s) for s in page]
    return "\n".join(blocks(root, {id(n): flags[y.number] for x, y in pairs for n in x.members}))


# --- the pages of all hosts ----------------------------------------------------------------------


def host() -> F.Column:
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), pattern, 1))


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


def merged_pivots(rows: DataFrame) -> DataFrame:
    """(host, pages, wrapper): the trees of the PIVOTS pages of least hash of each host, merged."""

    def candidates(batches):
        """The pages of least hash of each host in a batch; only those are parsed."""
        for batch in batches:
            least: dict[str, dict[int, str]] = {}
            count: dict[str, int] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count[name] = count.get(name, 0) + 1
                kept = least.setdefault(name, {})
                kept[hash_of(value)] = value
                if len(kept) > PIVOTS:
                    del kept[max(kept)]
            found = [(n, h, written(folded(parse(p))), 0) for n, kept in least.items() for h, p in kept.items()]
            found += [(n, -1, None, k) for n, k in count.items()]
            columns = list(zip(*found)) if found else [()] * 4
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["host", "h", "wrapper", "pages"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    found = stored(rows.mapInArrow(candidates, "host string, h long, wrapper string, pages long"), "pivots")
    counts = found.filter("wrapper IS NULL").groupBy("host").agg(F.sum("pages").alias("pages"))
    # equal pages have one hash; the rank is cut off in each task before the shuffle
    rank = F.dense_rank().over(Window.partitionBy("host").orderBy("h"))
    chosen = (
        found.filter("wrapper IS NOT NULL")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= PIVOTS)
        .groupBy("host", "rank")
        .agg(F.first("wrapper").alias("wrapper"))
        .groupBy("host")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "wrapper"))), lambda x: x["wrapper"]).alias("trees"))
    )

    def merge(batches):
        for batch in batches:
            trees = [written(merged([read(t)[0] for t in ts])) for ts in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(trees, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "pages", "wrapper"])

    both = chosen.join(counts, "host").select("host", "pages", "trees")
    return stored(both.mapInArrow(merge, "host string, pages long, wrapper string"), "merged")


class Wrappers:
    """The wrappers of the hosts by name, read once in each task; for large sets, from the rows."""

    def __init__(self, shared):
        self.shared, self.held = shared, {}

    def of(self, name: str, source: str | None):
        source = self.shared.value.get(name) if self.shared else source
        if name not in self.held:
            if len(self.held) >= 1000:
                self.held.clear()
            self.held[name] = read(source) if source else None
        return self.held[name]


def with_wrappers(rows: DataFrame, wrappers: DataFrame) -> tuple[DataFrame, object]:
    """``rows`` with a column wrapper, and a broadcast. If all wrappers are small (checked) they
    are broadcast by host and the column is null; else they are joined, hot hosts apart."""
    size = wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        known = {r.host: r.wrapper for r in wrappers.select("host", "wrapper").collect()}
        return rows.withColumn("wrapper", F.lit(None).cast("string")), rows.sparkSession.sparkContext.broadcast(known)
    return join_groups(rows, wrappers, "host", "pages"), None


def induced_wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper): one wrapper for each host, learned from all its pages.

    The trees of a few pages are merged into a wrapper. Every page of the host is then aligned
    with it, and what each slot holds is summed over all pages: characters, those in links, how
    many different values it has, and how many different main texts stand on the same pages (the
    text of the heaviest slot of a page; copies of one article prove nothing about a slot). Counts
    of different values are sketches, which Spark combines before the shuffle. See ``verdicts``.
    """
    rows = pages.select(host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    merged_ = merged_pivots(rows)
    met, shared = with_wrappers(rows, merged_)

    def sums(batches):
        wrappers = Wrappers(shared)
        for batch in batches:
            found = {}
            for name, page, source in zip(*(batch.column(k).to_pylist() for k in range(3))):
                tree = folded(parse(page))
                main = hash_of(max([s.text for s in tree], key=len))
                for x, y in aligned(tree, wrappers.of(name, source)[0]):
                    if x.text:
                        key = (name, y.number, hash_of(x.text), main)
                        size, links = found.get(key, (0, 0))
                        found[key] = (size + len(x.text), links + x.links)
            columns = [*zip(*found)] if found else [()] * 4
            columns += [*zip(*found.values())] if found else [()] * 2
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4]
            names = ["host", "slot", "value", "main", "size", "links"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    totals = (
        met.select("host", "html", "wrapper")
        .mapInArrow(sums, "host string, slot int, value long, main long, size long, links long")
        .groupBy("host", "slot")
        .agg(
            F.sum("size").alias("size"),
            F.sum("links").alias("links"),
            F.approx_count_distinct("value").alias("n_values"),
            F.approx_count_distinct("main").alias("n_mains"),
        )
        .groupBy("host")
        .agg(F.collect_list(F.struct("slot", "size", "links", "n_values", "n_mains")).alias("slots"))
    )

    def judge(batches):
        for batch in batches:
            out = []
            for source, slots in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                order = read(source)[0]
                found = {x["slot"]: (x["size"], x["links"], x["n_values"], x["n_mains"]) for x in slots or []}
                mains = max([x[3] for x in found.values()], default=0)
                out.append(written(order, *verdicts(order, found, mains >= LEAST)) if mains > 1 else written(order))
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "pages", "wrapper"])

    both = merged_.join(totals, "host", "left").select("host", "pages", "wrapper", "slots")
    return stored(both.mapInArrow(judge, "host string, pages long, wrapper string"), "wrappers")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Pages of a host share a wrapper, which says where the article is and what repeats; pages
    without a host share one too. Elements that by their tag, role or style are menus, footers,
    sidebars, forms or hidden never count, nor do reader comments by their class outside articles.
    Null and empty pages have an empty text. Repeated rows give repeated results; an empty table
    gives an empty one; other columns are ignored.
    """
    wrappers = induced_wrappers(pages)
    html = F.coalesce("html", F.lit("")).alias("html")
    met, shared = with_wrappers(pages.select("page_id", "url", host().alias("host"), html), wrappers)

    def run(batches):
        held = Wrappers(shared)
        for batch in batches:
            names, sources = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            found = [main_text(parse(p.as_py()), held.of(n, s)) for p, n, s in zip(batch.column(2), names, sources)]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    schema = "page_id long, url string, text string, n_chars long"
    return met.select("page_id", "url", "html", "host", "wrapper").mapInArrow(run, schema)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
