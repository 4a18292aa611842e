"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page's token stream is read as nested elements with text runs. Aligning it with the wrapper of its host so far turns every mismatch into
part of the expression: texts that differ become slots, elements that some pages lack become optional, and elements that come back
become repeated, alone or as a group with what stands between them (whose members are optional). An expression has no alternatives.

A wrapper holds, for each place (the path of element names with their class, id and role words), which children were seen, which of them
are optional or repeated, and which stood behind which; ``form`` gives the expression of a place. So aligning is a union, and the wrapper
doesn't depend on the order in which pages are met. Of texts it holds digests, never words.

Wrappers are folded inside each partition, then per host and salt, then per host, so a host with a third of the pages meets as many partial
wrappers as there are partitions, never its pages. What they say decides each page's text:

- A text that the wrapper holds constant on at least ``TEMPLATE`` different pages is the host's template and goes (inside an article, main
  or content part: on ``MANY``, as two near copies may share all but a word). A text among repeated siblings is in a slot and stays.
- Pages of a host with the same landmarks (article, main, content parts) share their main region: the article part, else the main part,
  else the content part, the first that holds at least ``SHARE`` of what these pages have in slots, else the whole page. Where articles lie
  inside the main part, that part comes first, so that what stands before and behind an article is kept.
- Menus, adverts, comments and so on go, by their element or by words in class, id and role. Outside of article and main parts one word of
  a compound (``top-nav``) is enough; inside them the whole token has to say it (``comment-list`` goes, ``related-work`` stays).

Defined cases: null or empty html gives an empty text; a null url, or one without host, shares one wrapper with all others such; pages
that are alone on their host, or copies of one page, are one page, so nothing counts as template; broken markup is read as browsers do in
the main (implied ends, ignored stray ends; an unclosed comment, script or style goes on to the end); nesting of any depth is followed;
equal rows give equal texts; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, in_small_batches, sized, table, width

#: Places that a worker holds before it hands on its wrappers so far, hosts whose decisions it keeps, and salts of a host.
PLACES, HOSTS, SALTS = 200_000, 2000, 64
#: Different pages of a host that must hold a constant text before it counts as template: outside of landmarks, and in them.
#: MANY is also the number of digests of pages that are kept for a text.
TEMPLATE, MANY = 2, 3
#: Pages of a host to each copy of its decisions where they are joined by shuffle.
COPY_PAGES = 20_000
#: Part of the text that the main region must hold.
SHARE = 1 / 3
#: Landmarks as bits; the last one marks an article inside a main part.
ARTICLE, MAIN, CONTENT, WITHIN = 4, 2, 1, 8

# Element names and words, as HTML and common practice use them.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure "
    "figcaption address details summary fieldset center hgroup search".split()
)
EXCLUDED = frozenset(
    "head title nav header footer aside form script style noscript template iframe object svg math canvas audio video button select option "
    "textarea label menu dialog legend datalist".split()
)
RAW = frozenset("script style noscript template iframe svg math textarea title object canvas audio video".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
ENDS = {
    "p": BLOCKS | {"nav", "header", "footer", "aside", "form", "hr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"}, "option": {"option"},
}
STOPS = frozenset("ul ol dl table div article section main body".split())
WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor "
    "sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe subscription "
    "newsletter paywall signup login search comment comments commentlist discussion disqus replies respond share sharing social related "
    "recommended breadcrumb breadcrumbs pagination pager toolbar widget complementary contentinfo hidden".split()
)
#: Words of parts that are never the frame of a page, whatever they hold.
STRICT = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion comment comments commentlist discussion disqus "
    "replies respond related recommended popup modal newsletter hidden".split()
)
#: Words that say nothing by themselves in a compound.
NEUTRAL = frozenset(
    "list lists area box block container wrapper wrap section slot unit item items post posts article articles story stories entry page site "
    "link links bar button buttons form inline top bottom left right inner outer main body content title text panel group row col column js "
    "primary secondary mobile desktop count icon icons thread".split()
)
LANDMARKS = ((MAIN, frozenset(["main"])), (CONTENT, frozenset(["content", "post", "entry", "story"])))
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][\w:-]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(frozen=True, slots=True)
class Kind:
    """What an element's tag says: its name and words, whether it is left out outside and inside of article and main parts and is never a
    frame, and its landmark."""

    key: str
    name: str
    outside: bool
    inside: bool
    strict: bool
    landmark: int


_kinds: dict[tuple[str, str], Kind] = {}


def kind_of(name: str, attributes: str) -> Kind:
    found = _kinds.get((name, attributes))
    if found is None:
        if len(_kinds) > 1 << 16:
            _kinds.clear()
        found = _kinds[name, attributes] = read_kind(name, attributes)
    return found


def read_kind(name: str, attributes: str) -> Kind:
    tokens: list[list[str]] = []
    for of, *values in ATTRIBUTE.findall(attributes) if "=" in attributes or "hidden" in attributes else ():
        whole = ["hidden"] if of.lower() == "hidden" else "".join(values).split()
        tokens += [[w.lower() for w in PART.findall(t)] for t in whole]
    words = dict.fromkeys(w for t in tokens for w in t)
    says = lambda wanted: any(not wanted.isdisjoint(t) and all(w in wanted or w in NEUTRAL for w in t) for t in tokens)
    frame = name in ("html", "body", "main")
    parts = {name, *words}
    landmark = ARTICLE if name == "article" else next((bit for bit, names in LANDMARKS if not names.isdisjoint(parts)), 0)
    landmark = 0 if name in ("html", "body") else landmark
    outside = name in EXCLUDED or (not frame and not WORDS.isdisjoint(words))
    inside = (name in EXCLUDED and name != "header") or (not frame and says(WORDS - {"header"}))
    return Kind(".".join([name, *words]), name, outside, inside, says(STRICT), landmark)


_raw_ends: dict[str, re.Pattern] = {name: re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I) for name in RAW}


class Page:
    """A page's elements and texts. Element 0 is the root; ``texts`` holds (element, text) in page order, without the parts left out."""

    def __init__(self, page: str):
        self.kinds, self.parents = [Kind("", "", False, False, False, 0)], [0]
        self.children: list[list[str]] = [[]]
        self.texts: list[tuple[int, str]] = []
        self._parse(page)
        self._judge()

    def _parse(self, page: str) -> None:
        stack, run, at = [0], [], 0
        opened: Counter = Counter()

        def end_run() -> None:
            if run:
                text = " ".join(entities.unescape("".join(run)).split())
                run.clear()
                if text:
                    self.texts.append((stack[-1], text))
                    self.children[stack[-1]].append("#")

        def close(depth: int) -> None:
            end_run()
            opened.subtract(self.kinds[k].name for k in stack[depth:])
            del stack[depth:]

        while at < len(page):
            tag = TOKEN.search(page, at)
            run.append(page[at : tag.start() if tag else len(page)])
            if not tag:
                break
            at = tag.end()
            end, name, attributes = tag.group(1, 2, 3) if tag.group(2) else tag.group(4, 5, 6)
            if not name:
                continue
            name = name.lower()
            if end:
                if opened[name] > 0:
                    close(next(d for d in range(len(stack) - 1, 0, -1) if self.kinds[stack[d]].name == name))
                continue
            if name in RAW:
                stop = _raw_ends[name].search(page, at)
                at = stop.end() if stop else len(page)
                continue
            if name in VOID:
                if name in ("br", "hr", "img"):
                    run.append(" ")
                continue
            kind = kind_of(name, attributes)
            if not (name in BLOCKS or name in EXCLUDED or kind.inside or kind.outside):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                above = self.kinds[stack[depth]].name
                if name in ENDS.get(above, ()):
                    close(depth)
                    break
                if above in STOPS:
                    break
            end_run()
            self.children[stack[-1]].append(kind.key)
            self.kinds.append(kind)
            self.parents.append(stack[-1])
            self.children.append([])
            stack.append(len(self.kinds) - 1)
            opened[name] += 1
        end_run()

    def _judge(self) -> None:
        """Which elements are left out, and the landmarks and the place of the others. A form, or an element named by words of
        ``WORDS``, that holds the page's article or main part is only its frame; so is one that holds a content part, if those words are
        but parts of its tokens (``with-sidebar``)."""
        n = len(self.kinds)
        holds = [0] * n
        for k in range(n - 1, 0, -1):
            kind = self.kinds[k]
            if (kind.name not in EXCLUDED or kind.name == "form") and not kind.strict:
                own = MAIN if kind.name in ("article", "main") else kind.landmark & CONTENT
                holds[self.parents[k]] |= holds[k] | own
        self.left_out, self.marks, self.places = [False] * n, [0] * n, [""] * n
        for k in range(1, n):
            kind, above = self.kinds[k], self.parents[k]
            marks = self.marks[above]
            frame = holds[k] & MAIN or (holds[k] & CONTENT and not kind.inside)
            never_frame = (kind.name in EXCLUDED and kind.name != "form") or kind.strict or not frame
            by_token = marks & (ARTICLE | MAIN) or (marks and kind.name == "header")
            self.left_out[k] = self.left_out[above] or (kind.inside if by_token else kind.outside and never_frame)
            if not self.left_out[k]:
                within = WITHIN if kind.landmark == ARTICLE and marks & MAIN else 0
                self.marks[k] = marks | kind.landmark | within
                self.places[k] = place(self.places[above], kind.key)
        self.texts = [(k, text) for k, text in self.texts if not self.left_out[k]]
        self.landmarks = 0
        for k, _ in self.texts:
            self.landmarks |= self.marks[k]


_places: dict[tuple[str, str], str] = {}


def place(above: str, key: str) -> str:
    """A short name of a path of keys."""
    found = _places.get((above, key))
    if found is None:
        if len(_places) > 1 << 16:
            _places.clear()
        found = _places[above, key] = blake2b(f"{above}/{key}".encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    return found


def digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


# A wrapper is {place: [children, followers]} and {place + "#": [constant, pages, volumes, marks]}: children are {key: 1 if optional + 2 if
# repeated}, followers {key: keys that stood behind it}; constant is the digest of the text or None in a slot, pages the ``MANY`` least
# digests of the pages that held it, so different pages count right up to ``MANY`` in whatever order they come, volumes the characters
# by landmarks of the page.


def expression(page: Page) -> dict[str, list]:
    """The wrapper of one page. Pages with the same texts outside of the parts left out are one page."""
    number = digest("\n".join(text for _, text in page.texts))
    found: dict[str, list] = {}
    for k, row in enumerate(page.children):
        if not page.left_out[k]:
            counts = Counter(row)
            own = [{key: 2 if n > 1 else 0 for key, n in counts.items()}, {}]
            for a, b in zip(row, row[1:], strict=False):
                if b not in own[1].setdefault(a, []):
                    own[1][a].append(b)
            add(found, page.places[k], own)
    for k, text in page.texts:
        own = [digest(text), [number], {str(page.landmarks): len(text)}, page.marks[k]]
        add(found, f"{page.places[k]}#", own)
    return found


def add(wrapper: dict[str, list], at: str, other: list) -> None:
    """Aligns what was seen at a place with what the wrapper has there."""
    own = wrapper.get(at)
    if own is None:
        wrapper[at] = other
    elif at.endswith("#"):
        pages = own[1] if own[1] == other[1] else sorted({*own[1], *other[1]})[:MANY]
        volumes = {m: own[2].get(m, 0) + other[2].get(m, 0) for m in own[2].keys() | other[2].keys()}
        wrapper[at] = [own[0] if own[0] == other[0] else None, pages, volumes, own[3]]
    else:
        (children, followers), (more, behind) = own, other
        if children != more:
            flags = lambda key: children.get(key, 1) | more.get(key, 1)
            children = {key: flags(key) for key in sorted(children.keys() | more.keys())}
        if followers != behind:
            followers = {key: sorted({*followers.get(key, ()), *behind.get(key, ())}) for key in sorted(followers.keys() | behind.keys())}
        wrapper[at] = [children, followers]


def united(a: dict[str, list], b: dict[str, list]) -> dict[str, list]:
    """The alignment of two wrappers."""
    whole = dict(a)
    for at, own in b.items():
        add(whole, at, own)
    return whole


def form(wrapper: dict[str, list], at: str = "") -> list[tuple[list[str], bool, bool]]:
    """The expression of a place: (keys, optional, repeated) in order. Keys that come back around each other are one repeated group,
    whose members are optional."""
    children, followers = wrapper.get(at, [{}, {}])
    reach: dict[str, set[str]] = {}
    for key in children:
        rest, seen = list(followers.get(key, ())), set()
        while rest:
            if (k := rest.pop()) not in seen:
                seen.add(k)
                rest += followers.get(k, ())
        reach[key] = seen
    groups = {frozenset([key, *(k for k in reach[key] if key in reach[k])]) for key in children}
    # What reaches more stands before; keys that never met stand by name.
    rank = lambda g: (-len(set().union(*(reach[k] for k in g)) - g), sorted(g))
    return [(sorted(g), len(g) > 1 or bool(children[min(g)] & 1), len(g) > 1 or bool(children[min(g)] & 2)) for g in sorted(groups, key=rank)]


def main_region(volumes: dict[int, int], landmarks: int) -> int:
    """The landmark whose parts are the main region, of characters by landmarks of their place; 0 for the whole page."""
    whole = sum(volumes.values())
    for bit in (MAIN, ARTICLE, CONTENT) if landmarks & WITHIN else (ARTICLE, MAIN, CONTENT):
        if 0 < (n := sum(v for marks, v in volumes.items() if marks & bit)) >= SHARE * whole:
            return bit
    return 0


def decisions(wrapper: dict[str, list]) -> dict:
    """What a wrapper says about its pages: the template's texts by place, and the main region by landmarks of the page."""
    template, volumes = {}, {}
    for at, own in wrapper.items():
        if at.endswith("#"):
            constant, pages, by_page, marks = own
            if constant is not None and len(pages) >= (MANY if marks else TEMPLATE):
                template[at] = constant
                continue
            for landmarks, n in by_page.items():
                of = volumes.setdefault(landmarks, {})
                of[marks] = of.get(marks, 0) + n
    return {"template": template, "region": {m: main_region(of, int(m)) for m, of in volumes.items()}}


def extract(page: str | None, said: dict) -> str:
    """The texts of the page's main region that aren't the host's template, block by block. ``said``: the decisions of the host's wrapper."""
    if not page:
        return ""
    read = Page(page)
    template = said.get("template", {})
    kept = [(read.marks[k], text) for k, text in read.texts]
    if template:
        kept = [(read.marks[k], text) for k, text in read.texts if template.get(f"{read.places[k]}#") != digest(text)]
    region = said.get("region", {}).get(str(read.landmarks))
    if region is None or (region and not any(marks & region for marks, _ in kept)):
        volumes: Counter = Counter()
        for marks, text in kept:
            volumes[marks] += len(text)
        region = main_region(volumes, read.landmarks)
    return " ".join(text for marks, text in kept if not region or marks & region)


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1))
    return pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) of all pages with their host."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[str, dict] = {}
        for pdf in batches:
            for host, page in zip(pdf["host"], pdf["html"], strict=True):
                if page:
                    of = have.setdefault(host, {})
                    for at, own in expression(Page(page)).items():
                        add(of, at, own)
            if sum(map(len, have.values())) >= PLACES:
                yield written(have)
                have = {}
        yield written(have)

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole: dict[str, list] = {}
        for w in pdf["wrapper"]:
            for at, own in json.loads(w).items():
                add(whole, at, own)
        return written({key[0]: whole})

    parts = in_small_batches(pages.select("host", "html")).mapInPandas(fold, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    first = salted.groupBy("host", "salt").applyInPandas(meet, "host string, wrapper string")
    return first.groupBy("host").applyInPandas(meet, "host string, wrapper string")


def written(have: dict[str, dict]) -> pd.DataFrame:
    return pd.DataFrame({"host": list(have), "wrapper": [json.dumps(w) for w in have.values()]}, dtype="object")


def with_decisions(pages: DataFrame, of: DataFrame) -> DataFrame:
    """page_id, url, html, said: by broadcast if all decisions (host_, said) are small, else by shuffle, where hosts of many pages have
    copies."""
    if (of.agg(F.sum(width(of))).first()[0] or 0) <= BROADCAST_BYTES:
        return pages.join(F.broadcast(of), pages.host == of.host_, "left").select("page_id", "url", "html", "said")
    large = pages.groupBy(F.col("host").alias("large_")).count().filter(F.col("count") > COPY_PAGES)
    large = cut(large.select("large_", F.ceil(F.col("count") / COPY_PAGES).cast("int").alias("copies_")))
    copies = F.coalesce("copies_", F.lit(1))
    dealt = pages.join(sized(large), F.col("host") == F.col("large_"), "left")
    dealt = dealt.withColumn("copy", F.pmod(F.xxhash64("page_id", "url", "html"), copies)).drop("large_", "copies_")
    copied = of.join(sized(large), F.col("host_") == F.col("large_"), "left")
    copied = copied.select("host_", "said", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy_"))
    same = (F.col("host") == F.col("host_")) & (F.col("copy") == F.col("copy_"))
    return dealt.join(copied.hint("shuffle_merge"), same, "left").select("page_id", "url", "html", "said")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = with_host(pages)
    decided = F.pandas_udf(lambda ws: ws.map(lambda w: json.dumps(decisions(json.loads(w)))), "string")
    of = cut(wrappers(pages).select(F.col("host").alias("host_"), decided("wrapper").alias("said")))

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: dict[str, dict] = {}
        for pdf in batches:
            texts = []
            for page, said in zip(pdf["html"], pdf["said"], strict=True):
                if said not in read:
                    if len(read) >= HOSTS:
                        read.clear()
                    read[said] = json.loads(said) if said else {}
                texts.append(extract(page, read[said]))
            n_chars = [len(t) for t in texts]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": n_chars})

    schema = "page_id long, url string, text string, n_chars long"
    return in_small_batches(with_decisions(pages, of)).mapInPandas(extracted, schema)


def op4_html_wrapper(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
