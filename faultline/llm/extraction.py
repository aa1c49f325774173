"""Main-text extraction with a site style tree.

Pages of a host are merged branch by branch (the path of tags, classes and roles from the body
down), marked branches too.  A branch whose content is spread evenly over few values - the same menu
on every page - has a low entropy of content per page; one whose content is new on every page has 1.
Its presentation (the tags of its blocks and those of the elements around them) has an entropy of
the same kind, which counts the more the more presentations there are.  Both make the importance of
a branch, which nears 1 on hosts of few pages, where entropy says little.

What a branch is marked as is evidence beside that: a block outside the marks counts the less the
more words of its page are inside marks, a block inside them the more.  Blocks that score too low
are cut, marked or not.
A block element whose class or id
is the name of something else (a whole token: `sidebar`, not `no-sidebar`) is left out unless it
holds the page's marked main text or, where no other text is marked, most of the page.

Defined cases: null html gives an empty text; a null or odd url makes a host of its own; repeated
rows give repeated rows and count as pages; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as H
import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from faultline.llm.frames import table
from faultline.scale import cut_lineage

#: Tags without an end, without text, and those that part blocks (HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas head title select "
                   "textarea button input form option datalist dialog".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt "
                  "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
                  "legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
                  "tr ul".split())
BOILER = frozenset("nav footer aside menu".split())
LANDMARK = frozenset(("article", "main"))
_NOISE = (r"(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|cookies?|"
          r"consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|nav|"
          r"navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|header|masthead|topbar|"
          r"comments?|commentlist|disqus|replies|reply|respond|related|recommended|share|"
          r"sharing|social|widget|toolbar|pagination|pager|legal|copyright|skip|search|"
          r"form|alert|toast|disclaimer)")
#: The name alone, and the name as a part of a longer one.
NOISE = re.compile(_NOISE + r"\d*", re.I)
PARTLY = re.compile(r"(?:^|[-_])" + _NOISE + r"(?:$|[-_\d])", re.I)
MAIN = re.compile(r"(?:^|[-_\s])(?:article|main|content|post|entry|story)(?:$|[-_\s\d])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar "
                  "alertdialog toolbar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|"
                   r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACE = re.compile(r"\s+")
#: A block is cut when it scores below this.
LEAST = 0.4
#: The importance of a branch weighs as if so many more pages had shown new content there.
PRIOR_PAGES = 4
#: How fast the number of presentations of a branch gives weight to their entropy.
GAMMA = 0.9
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
           "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _kind(tag: str, attributes: str, inside: bool) -> int:
    """2 for a branch marked as main text, 0 for one marked as something else, 1 for neither.

    3: only a name says that it is something else.
    """
    if tag in HIDDEN or tag in BOILER or (tag == "header" and not inside):
        return 0
    kind = 2 if tag in LANDMARK else 1
    if attributes and not attributes.isspace():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return 0
            if name == "role":
                if value.lower() in ROLES:
                    return 0
                kind = 2 if value.lower() in ("main", "article") else kind
            elif name in ("class", "id"):
                names = value.split()
                if kind != 2 and tag not in ("body", "html") and any(map(NOISE.fullmatch, names)):
                    if tag not in BLOCK:
                        return 0
                    kind = 3
                # a wrapper named after both (content-sidebar-wrap) is neither
                if kind == 1 and any(MAIN.search(x) and not PARTLY.search(x) for x in names):
                    kind = 2 if tag in ("div", "section", "td") else kind
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return 0
    return kind


def blocks(page: str) -> list[tuple[str, str, bool, str]]:
    """(branch, text, inside a marked main text, tags around) of every block not marked otherwise."""
    out: list[tuple[str, str, bool, str, tuple]] = []
    stack: list[list] = []  # [tag, label, kind]
    named: list[tuple[int, int]] = []  # open branches of kind 3: number, marks around it
    numbers = itertools.count()
    words: list[str] = []
    muted = marked = 0
    at, n = 0, len(page)

    def flush() -> None:
        if words:
            text = SPACE.sub(" ", "".join(words)).strip()
            words.clear()
            if text:
                out.append((">".join(s[1] for s in stack if s[1]), text, marked > 0,
                            ">".join(s[0] for s in stack), tuple((k, marked > around) for k, around in named)))

    def leave(depth: int) -> None:
        nonlocal muted, marked
        while len(stack) > depth:
            if stack[-1][0] in BLOCK and not muted:
                flush()
            tag, _, kind = stack.pop()
            muted -= kind == 0
            marked -= kind == 2
            if kind == 3:
                named.pop()

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            rest = page[at:]
            if not muted:
                words.append(H.unescape(rest))
            break
        if m.start() > at and not muted:
            raw = page[at:m.start()]
            words.append(H.unescape(raw) if "&" in raw else raw)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    leave(depth)
                    break
            else:
                if tag in BLOCK and not muted:
                    flush()
            continue
        if tag in ("p",) or tag in BLOCK and tag not in ("html", "body"):
            for depth in range(len(stack) - 1, -1, -1):  # an open paragraph ends here
                if stack[depth][0] == "p":
                    leave(depth)
                    break
                if stack[depth][0] in BLOCK:
                    break
        if tag in _CLOSES:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in _CLOSES[tag]:
                    leave(depth)
                    break
                if stack[depth][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag in BLOCK and not muted:
            flush()
        if tag == "br" and not muted:
            words.append(" ")
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        kind = _kind(tag, m[3], marked > 0)
        label = ""
        if tag in BLOCK and tag not in ("html", "p"):
            name = re.search(r"(?:class|id|role)\s*=\s*[\"']?([\w-]+)", m[3])
            label = f"{tag}.{re.sub(r'[0-9]+', '', name[1])}" if name else tag
        stack.append([tag, label, kind])
        muted += kind == 0
        if kind == 3:
            named.append((next(numbers), marked))
        marked += kind == 2
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            if end is None:
                at = n
            else:
                at = end.end()
                leave(len(stack) - 1)
    leave(0)
    flush()
    return _lifted(out)


def _lifted(found: list[tuple[str, str, bool, str, tuple]]) -> list[tuple[str, str, bool, str]]:
    """The blocks without those in a branch whose name says that it holds no article text.

    Such a branch stays if at least half of the marked text is marked inside it, or if nothing is
    marked outside and it holds over half of the page.
    """
    if not any(f[4] for f in found):
        return [f[:4] for f in found]
    total = main = 0
    inside: dict[int, list[int]] = {}  # words, marked words, those marked inside
    for _, text, marked, _, within in found:
        n = len(text.split())
        total += n
        main += n * marked
        for k, own in within:
            t = inside.setdefault(k, [0, 0, 0])
            t[0] += n
            t[1] += n * marked
            t[2] += n * own
    stays = {k for k, (n, marked, own) in inside.items()
             if own and 2 * own >= main or marked == main and 2 * n > total}
    return [f[:4] for f in found if all(k in stays for k, _ in f[4])]


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)),
                      F.lit(""))


def _digest(parts: list[str]) -> str:
    return hashlib.blake2b("\n".join(parts).encode("utf-8", "replace"), digest_size=12).hexdigest()


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, branch, pages, content, presentation, importance): the merged tree of each host.

    content and presentation = entropy over the branch's pages / log(pages): 0 when every page has
    the same there, 1 when none repeats.
    """

    def run(batches):
        for batch in batches:
            seen: dict[tuple[str, str, bool, str], int] = {}
            for where, page in zip(*(c.to_pylist() for c in batch.columns)):
                found: dict[str, list[str]] = {}
                looks: dict[str, list[str]] = {}
                for branch, text, _, look in blocks(page):
                    found.setdefault(branch, []).append(text)
                    looks.setdefault(branch, []).append(look)
                for style, of in ((False, found), (True, looks)):
                    for branch, parts in of.items():
                        key = where, branch, style, _digest(parts)
                        seen[key] = seen.get(key, 0) + 1
            keys = list(seen)
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
                + [pa.array(list(seen.values()), pa.int64())], ["host", "branch", "style", "value", "n"])

    parts = pages.where("html IS NOT NULL").select(host(F.col("url")).alias("host"), "html").mapInArrow(
        run, "host string, branch string, style boolean, value string, n long")
    same = parts.groupBy("host", "branch", "style", "value").agg(F.sum("n").alias("n"))
    nlogn = F.col("n") * F.log("n")
    node = same.groupBy("host", "branch").agg(
        F.sum(F.when(F.col("style"), F.col("n"))).alias("pages"),
        F.count_if("style").alias("styles"),
        F.sum(F.when(~F.col("style"), nlogn)).alias("c"), F.sum(F.when(F.col("style"), nlogn)).alias("p"))

    def spread(c: str) -> Column:
        return F.when(F.col("pages") > 1, (F.log("pages") - F.col(c) / F.col("pages")) / F.log("pages")
                      ).otherwise(1.0)

    node = node.withColumns({"content": spread("c"), "presentation": spread("p")})
    varied = (1 - F.pow(F.lit(GAMMA), F.col("styles") - 1)) * F.col("presentation")
    own = F.col("content") + (1 - F.col("content")) * varied
    return node.select("host", "branch", "pages", "content", "presentation", (
        (own * F.col("pages") + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)).alias("importance"))


def chosen(found: list[tuple[str, str, bool, str]], importance: dict[str, float]) -> list[str]:
    """The texts of a page's blocks that score enough; a branch not in `importance` has 1."""
    sizes = [len(text.split()) for _, text, _, _ in found]
    main = sum(n for n, b in zip(sizes, found) if b[2]) / max(1, sum(sizes))
    top = max((importance.get(b[0], 1.0) for b in found), default=1.0)
    out = []
    for branch, text, marked, _ in found:
        own = importance.get(branch, 1.0)
        # marked text is measured by the best of its page: a page that is copied whole stays
        if (own / top * (1 + main) / 2 if marked else own * (1 - main)) >= LEAST:
            out.append(text)
    return out


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with text and n_chars, which replace columns of these names."""
    # one row per host that repeats itself, its branches only
    tree = cut_lineage(style_tree(pages).where("importance < 0.999").groupBy("host").agg(
        F.map_from_entries(F.collect_list(F.struct("branch", "importance"))).alias("_tree"))
        .withColumnRenamed("host", "_host"))
    keep = [c for c in keep if c not in ("text", "n_chars")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
                        F.col("html").cast("string").alias("_html"), host(F.col("url")).alias("_at"))
    rows = rows.join(tree, rows["_at"] == tree["_host"], "left").select("_row", "_tree", "_html")
    fields = StructType([rows.schema["_row"], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches):
        for batch in batches:
            texts = ["\n".join(chosen(blocks(page), dict(tree or ()))) if page else ""
                     for tree, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["_row", "text", "n_chars"])

    return rows.mapInArrow(run, fields).select("_row.*", "text", "n_chars")


def op4_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
