"""Main text of web pages by union-free wrappers inferred for each host.

A page is a stream of tokens: the opening and closing tokens of block elements (label: tag
and classes) and the texts between them; scripts, styles, comments and inline markup vanish
or join the text around them. As blocks are balanced, a stream is kept nested, an element
with the stream inside it. Its own wrapper is the stream with runs of equal elements, or of
equal short sequences of elements, made into repeated groups, and each text as a set of
hashed strings (several where it repeats). Two wrappers of a host are aligned token by token
along a longest common subsequence of labels: what matches is aligned further inside, a
mismatch of tokens becomes optional or a repeated group, and a mismatch of strings a slot,
as a text keeps the strings that both sides hold. The result is again a regular expression
without unions (`expression` writes it out), and alignment is repeated until one wrapper
accepts every page of the host.

Equal pages of a host count once. Pages of one host and structure first agree on their
strings, in any order and by partial results, then their wrappers are folded in `salts`
parts for each host and then across the parts; each fold reads a sorted stream and holds
one wrapper, so a host with a third of all pages is no group in memory.

Texts count as main text if they lie in an article or main element, in no menu, header,
footer, sidebar, notice, advert, form or comment region. Nothing in an article is dropped
for being on many pages. On pages that have neither element the body counts, less what is
fixed: a string that all pages hold which have its element (for an optional one, those that
have it) is the template's, if they are `FIXED` distinct pages or more, and the slots that
are left are the page's own text. A page's texts are found by their label path in its
host's wrapper.

A null html is empty and gives an empty text; a null url belongs to one host of its own;
pages without any markup are their text; blocks nested over DEPTH deep are siblings, as in
browsers, with their text and its region kept; unclosed and stray tags are repaired as browsers
do for paragraphs and list items; repeated rows are extracted alike; very long pages are
read whole; an empty table gives an empty result; only the id, the url and the html are
read, so no column clashes.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

SALTS, TEXT, DEPTH, FIXED = 16, "#", 200, 4
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>", re.S | re.I
)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that an opening tag of the same row closes, if they are the innermost open block.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
NO_P_INSIDE = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
ASIDE_TAGS = frozenset("nav footer aside form button select textarea dialog menu head title object audio video canvas datalist fieldset".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies consent notice notices gdpr popup modal newsletter subscribe social share sharing related comment comments disqus replies respond login search widget pagination pager skip hidden".split()
)
HEAD_WORDS = frozenset("header masthead topbar".split())
#: Words that may stand beside such a word in a class name; names with others ("has-sidebar", "no-comments") tell nothing.
LAYOUT_WORDS = frozenset(
    "box block list form area section container wrapper wrap inner outer bar top bottom left right main primary secondary site page global mobile desktop link links icon icons button buttons post posts item items text title label policy overlay slot unit sticky fixed toggle group panel row col column".split()
)
#: First words of names that are side regions whatever follows, but for words of state.
PREFIXES = frozenset("widget sidebar breadcrumb breadcrumbs cookie newsletter pagination disqus gdpr advert advertisement navbar sponsored ads".split())
STATES = frozenset("enabled disabled open opened closed active inactive visible on off collapsed expanded has with without no not is".split())
#: Elements that no class name makes a side region.
KEPT_TAGS = frozenset("html body main article".split())
HIDDEN = "!hidden"


def label(tag: str, attributes: str) -> str:
    """tag, then the names in class, id and role, digits left out, in order of the alphabet."""
    names = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            names |= {re.sub(r"\d+", "", x).lower() for x in value.split()}
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and NO_DISPLAY.search(value)):
            names.add(HIDDEN)
    return ".".join([tag, *sorted(x for x in names if x)])


def named(name: str, words: frozenset, prefixes: frozenset = frozenset()) -> bool:
    """Whether a class name as a whole says one of the words."""
    parts = [x for x in re.split(r"[-_:]+", name) if len(x) > 1]
    if not parts or STATES & set(parts):
        return False
    return parts[0] in prefixes or (any(x in words for x in parts) and all(x in words or x in LAYOUT_WORDS for x in parts))


@lru_cache(maxsize=65536)
def kind(label: str) -> tuple[bool, bool, bool]:
    """Whether an element is an article, a region beside the main text, and a page's head."""
    tag, *names = label.split(".")
    article = tag in ("article", "main") or any(x in ("article", "main") for n in names for x in re.split(r"[-_:]+", n))
    if tag in KEPT_TAGS:
        return article, HIDDEN in names and tag in ("article", "main"), False
    side = tag in ASIDE_TAGS or HIDDEN in names or any(named(n, ASIDE_WORDS, PREFIXES) for n in names)
    return article, side, tag == "header" or any(named(n, HEAD_WORDS) for n in names)


def marked_by(label: str, inside: bool, aside: bool) -> tuple[bool, bool]:
    """Whether what an element holds lies in an article, and beside the main text, from the same of the element's place."""
    article, side, top = kind(label)
    return inside or article, aside or side or (top and not inside)


def tree(html: str) -> list:
    """[label, children]; a child is a text or another such list.

    Beyond DEPTH only elements are opened that begin an article or a side region, so each
    text keeps its marks; of the others the names are held until they close.
    """
    root: list = ["", []]
    opened, text, at = [root], [], 0
    marks, deeper = [(False, False)], [([], Counter())]

    def close(depth: int):
        del opened[depth:], marks[depth:], deeper[depth:]

    def flush():
        if text:
            opened[-1][1].append("".join(text))
            text.clear()

    for m in TOKEN.finditer(html):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        if m[2]:
            for depth in range(len(opened) - 1, -1, -1):
                names, held = deeper[depth]
                if held[tag]:
                    close(depth + 1)
                    while (last := names.pop()) != tag:
                        held[last] -= 1
                    held[tag] -= 1
                    break
                if depth and opened[depth][0].split(".", 1)[0] == tag:
                    close(depth)
                    break
            continue
        closing = CLOSES.get(tag, {"p"} if tag in NO_P_INSIDE else set())
        while len(opened) > 1 and not deeper[-1][0] and opened[-1][0].split(".", 1)[0] in closing:
            close(len(opened) - 1)
        node = [label(tag, m[4]), []]
        opened[-1][1].append(node)
        if tag not in VOID and not m[4].endswith("/"):
            mark = marked_by(node[0], *marks[-1])
            if len(opened) > DEPTH and (mark == marks[-1] or marks[-1][1]):
                deeper[-1][0].append(tag)
                deeper[-1][1][tag] += 1
            else:
                opened.append(node)
                marks.append(mark)
                deeper.append(([], Counter()))
    text.append(html[at:])
    flush()
    return root


# A wrapper is [label, repeated, optional, children]; a group of siblings has the label "()", a text the label TEXT
# and two more fields: the number of distinct pages that have it, and the hashes of the strings all of them hold.


def plain(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def collapsed(children: list, own: bool = False) -> list:
    """children with runs of siblings, and of sequences of two or three of them, as repeated groups.

    own: they are of one page, where what is optional in a repeated element still stands on the page.
    """

    def merged(a: list, b: list, inside: bool = True) -> list:
        return aligned(a, b, (own or (inside and not a[2]), own or not b[2]), own)

    out: list = []
    for child in children:
        if out and out[-1][0] == child[0]:
            out[-1] = merged(out[-1], child)
            out[-1][1] = True
            continue
        out.append(child)
        for width in (2, 3):
            if len(out) > width and out[-width - 1][0] == "()" and [x[0] for x in out[-width - 1][3]] == [x[0] for x in out[-width:]]:
                group = out[-width - 1]
                group[3] = [merged(a, b, not group[2]) for a, b in zip(group[3], out[-width:], strict=True)]
                del out[-width:]
                break
            if len(out) >= 2 * width and [x[0] for x in out[-width:]] == [x[0] for x in out[-2 * width : -width]]:
                group = ["()", True, False, [merged(a, b) for a, b in zip(out[-2 * width : -width], out[-width:], strict=True)]]
                out[-2 * width :] = [group]
                break
    return out


def own_wrapper(page: list) -> list:
    """The wrapper of one page's tree."""

    def made(node: list) -> list:
        # strings are sets that grow in place until the page is done, so that long runs take linear time
        children = [[TEXT, False, False, [], 1, {hashed(plain(x))}] if isinstance(x, str) else made(x) for x in node[1] if not isinstance(x, str) or x.strip()]
        return [node[0], False, False, collapsed(children, own=True)]

    wrapper = made(page)
    for x in texts_of(wrapper):
        x[5] = sorted(x[5])
    return wrapper


def texts_of(w: list) -> list[list]:
    """The text nodes of a wrapper, in order."""
    return [w] if w[0] == TEXT else [x for child in w[3] for x in texts_of(child)]


def key(w: list) -> str:
    return f"({' '.join(x[0] for x in w[3])})" if w[0] == "()" else w[0]


def common(a: list, b: list, sure: tuple[bool, bool] | None) -> list:
    """The number of pages and the strings of a text that two texts become."""
    if sure is None:
        return [a[4] + b[4], sorted(set(a[5]) & set(b[5]))]
    if all(sure):
        if isinstance(a[5], set):
            a[5].update(b[5])
            return [max(a[4], b[4]), a[5]]
        return [max(a[4], b[4]), sorted(set(a[5]) | set(b[5]))]
    if any(sure):
        return (a if sure[0] else b)[4:]
    both = set(a[5]) & set(b[5])
    return [max(a[4], b[4]), both if isinstance(a[5], set) else sorted(both)]


def aligned(a: list, b: list, sure: tuple[bool, bool] | None = None, own: bool = False) -> list:
    """The wrapper of what two wrappers of one label describe.

    sure: None for wrappers of different pages; for siblings, whether each stands on all
    pages that their parent is on. own: siblings of one page.
    """
    if a[0] == TEXT:
        return [TEXT, a[1] or b[1], a[2] or b[2], [], *common(a, b, sure)]

    def down(p: list, q: list) -> list:
        return aligned(p, q, sure and (sure[0] and (own or not p[2]), sure[1] and (own or not q[2])), own)

    x, y = a[3], b[3]
    if len(x) == len(y) and all(key(p) == key(q) for p, q in zip(x, y, strict=True)):
        merged = [down(p, q) for p, q in zip(x, y, strict=True)]
    else:
        length = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                length[i][j] = length[i + 1][j + 1] + 1 if key(x[i]) == key(y[j]) else max(length[i + 1][j], length[i][j + 1])
        merged, i, j = [], 0, 0
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and key(x[i]) == key(y[j]):
                merged.append(down(x[i], y[j]))
                i, j = i + 1, j + 1
            elif j == len(y) or (i < len(x) and length[i + 1][j] >= length[i][j + 1]):
                merged.append([*x[i][:2], True, *x[i][3:]])
                i += 1
            else:
                merged.append([*y[j][:2], True, *y[j][3:]])
                j += 1
        merged = collapsed(merged, own)
    return [a[0], a[1] or b[1], a[2] or b[2], merged]


def stream(node: list) -> str:
    """The token stream of a page's tree, a text by its hash."""
    inner = "".join(f"#{hashed(plain(x))};" if isinstance(x, str) else stream(x) for x in node[1] if not isinstance(x, str) or x.strip())
    return f"<{node[0]}>{inner}</{node[0]}>"


def expression(w: list, many: bool = False) -> str:
    """The regular expression over token streams that a wrapper stands for. many: it is in a repeated group, where strings are slots."""
    many = many or w[1]
    if w[0] == TEXT:
        one = f"#{w[5][0]};" if len(w[5]) == 1 and not many else "#-?[0-9]+;"
    else:
        one = "".join(expression(x, many) for x in w[3])
        if w[0] != "()":
            one = f"<{re.escape(w[0])}>{one}</{re.escape(w[0])}>"
    one = f"(?:{one})+" if w[1] else one
    return f"(?:{one})?" if w[2] else one


def regions(wrapper: list) -> dict[str, tuple[bool, bool, set[int]]]:
    """Label paths of elements: whether each lies in an article, and in a region beside the main text; its fixed strings."""
    found: dict[str, tuple[bool, bool, set[int]]] = {}

    def walk(node: list, path: str, inside: bool, aside: bool):
        if node[0] == TEXT:
            if node[4] >= FIXED:
                found.setdefault(path, (inside, aside, set()))[2].update(node[5])
            return
        if node[0] != "()":
            path = f"{path}/{node[0]}"
            inside, aside = marked_by(node[0], inside, aside)
            found.setdefault(path, (inside, aside, set()))
        for child in node[3]:
            walk(child, path, inside, aside)

    walk(wrapper, "", False, False)
    return found


def main_text(html: str, marked: dict[str, tuple[bool, bool, set[int]]]) -> str:
    """The blocks of html whose paths are main text: inside its articles, or if it has none, those of all the page that aren't fixed."""
    blocks: list[tuple[bool, str]] = []
    scoped, todo = False, [(tree(html), "/")]
    while todo:  # depth first, children in page order
        node, path = todo.pop()
        inside, aside, fixed = marked.get(path, (False, True, ()))
        if aside:
            continue
        if isinstance(node, str):
            if (text := plain(node)) and (inside or not (fixed and hashed(text) in fixed)):
                blocks.append((inside, text))
            continue
        scoped = scoped or inside
        todo += [(child, path if isinstance(child, str) else f"{path}/{child[0]}") for child in reversed(node[1])]
    return "\n\n".join(text for inside, text in blocks if inside or not scoped)


@lru_cache(maxsize=4096)
def marks(wrapper: str) -> dict[str, tuple[bool, bool, set[int]]]:
    return regions(json.loads(wrapper))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def folded(rows: DataFrame, by: list[str]) -> DataFrame:
    """One wrapper (JSON) for each group, aligned from a stream sorted by group."""

    def run(batches):
        now, wrapper, keys, out = None, None, [], []
        for batch in batches:
            for *group, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now:
                    if now is not None:
                        keys.append(now)
                        out.append(json.dumps(wrapper))
                    now, wrapper = group, json.loads(text)
                else:
                    wrapper = aligned(wrapper, json.loads(text))
        if now is not None:
            keys.append(now)
            out.append(json.dumps(wrapper))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in keys], pa.string()), pa.array(out, pa.string())], names=["host", "wrapper"])

    ordered = rows.select(*by, "wrapper").repartition(*by).sortWithinPartitions(*by, "wrapper")
    return ordered.mapInArrow(run, "host string, wrapper string")


def packed(sets: list[list[int]]) -> bytes:
    return np.array([len(sets), *map(len, sets), *(h for some in sets for h in some)], "<i8").tobytes()


def unpacked(raw: bytes) -> list[list[int]]:
    flat = np.frombuffer(raw, "<i8")
    ends = np.cumsum(flat[: flat[0] + 1])
    return [flat[1 + a : 1 + b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def agreed(rows: DataFrame) -> DataFrame:
    """rows (host, wrapper, n, texts), sorted by host and wrapper in each partition: those that are equal as one, with the strings all hold."""

    def run(batches):
        now, n, sets, out = None, 0, [], []
        for batch in batches:
            for host, wrapper, count, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, wrapper) != now:
                    if now is not None:
                        out.append((*now, n, packed([sorted(x) for x in sets])))
                    now, n, sets = (host, wrapper), 0, [set(x) for x in unpacked(raw)]
                else:
                    sets = [x.intersection(y) if x else x for x, y in zip(sets, unpacked(raw), strict=True)]
                n += count
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("host", "wrapper", "n", "texts"), x, strict=True)) for x in out], kinds)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"host": now[0], "wrapper": now[1], "n": n, "texts": packed([sorted(x) for x in sets])}], kinds)

    kinds = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("n", pa.int64()), ("texts", pa.binary())])
    return rows.mapInArrow(run, "host string, wrapper string, n long, texts binary")


def wrappers(pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """(host, wrapper) for all pages (host, html); strings of fewer than FIXED pages are left out."""

    def structures(batches):
        for batch in batches:
            own = [own_wrapper(tree(x or "")) for x in batch.column(1).to_pylist()]
            texts = [packed([x[5] for x in texts_of(w)]) for w in own]
            for w in own:
                for x in texts_of(w):
                    del x[4:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(json.dumps, own), pa.string()), pa.array(texts, pa.binary())], names=["host", "wrapper", "texts"])

    def filled(batches):
        for batch in batches:
            out = []
            for wrapper, n, raw in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                w = json.loads(wrapper)
                for x, strings in zip(texts_of(w), unpacked(raw), strict=True):
                    x += [n, strings]
                out.append(json.dumps(w))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "wrapper"])

    def told(batches):
        for batch in batches:
            out = [json.loads(x) for x in batch.column(1).to_pylist()]
            for w in out:
                for x in texts_of(w):
                    x[5] = x[5] if x[4] >= FIXED else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(json.dumps, out), pa.string())], names=["host", "wrapper"])

    each = pages.select("host", "html").mapInArrow(structures, "host string, wrapper string, texts binary").distinct()
    each = each.select("host", "wrapper", F.lit(1).cast("long").alias("n"), "texts").sortWithinPartitions("host", "wrapper")
    each = agreed(agreed(each).repartition("host", "wrapper").sortWithinPartitions("host", "wrapper"))
    each = each.mapInArrow(filled, "host string, wrapper string")
    salted = each.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    return folded(folded(salted, ["host", "salt"]), ["host"]).mapInArrow(told, "host string, wrapper string")


def extracted(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", salts: int = SALTS) -> DataFrame:
    """(page_id, url, text, n_chars) of all pages."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    found = stored(wrappers(rows, salts).withColumnRenamed("host", "_host"), "wrappers")

    def run(batches):
        for batch in batches:
            texts = [main_text(h or "", marks(w)) for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(found, rows["host"].eqNullSafe(found["_host"])).select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op5_union_free_wrappers": op5}
