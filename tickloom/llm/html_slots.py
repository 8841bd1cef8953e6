"""Main text of web pages by equivalence-class template deduction per host.

A token is a start or end tag together with its place: the chain of elements, with their
classes, that it stands in; or a word with the place of its element and the word before it
in its block. Over all pages of a host, tokens with the same occurrence vector
(how often they are in page 1, page 2, ...) form an equivalence class. Vectors are compared
by the sum of one hash per page and count, which Spark adds up in any order, so hosts of
any size are counted without being brought together. Classes that at least half of a
host's pages have, and in which elements are opened and closed alike, are valid; nested by
their places they are the host's template. Words are in it if their class is that of a
template element around them, or if they are a valid class of their own: ``CLASS_WORDS`` or more
words in a row with one vector. What the template does not fix are its slots,
and the slot with the article is the region: an element that the template has once per
page, by name if the host marks its articles, otherwise the innermost one that holds most
of the text outside boilerplate.

Equal vectors are no chance if they are so often: a run of words is the template's if its words
times the host's pages are at least ``EVIDENCE``. So one word is enough on hosts of twelve
pages, and on two pages it takes six in a row. On hosts with fewer pages that mark their
articles by name (``article``, ``main``), the marks alone decide. All pages of a host, dealt
into parts of about ``PART`` pages, show which words to count on all its pages: those that at
least half of a part's pages have, with the vector of an element around them or in a row with
one vector there. What half of a host's pages have, half of some part's pages have, and vectors
that are equal on all pages are equal in every part, so no word of the template is passed over.

A page's text is what its host's region holds, without menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments. Class words do not make boilerplate
of html, body, article or main, nor of a place that holds most of the host's text outside
boilerplate tags. A page without text in the region falls back to its article or main element,
to its body, and last to what only class words call boilerplate. Character references are decoded,
white space inside a block becomes one space, and blocks are joined by a line break. Words
of the template are left out, unless nothing else is left of a page (its host's pages are all
the same), or, in marked articles, unless they are more than half of a page's words in the
region: such pages are copies of each other. No other text is dropped for being frequent.

Null and empty html give an empty text; a null url is a host of its own. Equal rows count
as one more page each. An empty table gives an empty table.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import compress, groupby, repeat

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.support import spread_join, whole, written

# A class is valid if this share of a host's pages has it.
SUPPORT = 0.5
# A region without a telling name holds this share of the text outside boilerplate.
MASS = 0.6

# Words in a row times pages that show that equal vectors are no chance.
EVIDENCE = 12
# Words in a row with one vector that are a class without an element's vector.
CLASS_WORDS = 3
# A host's pages are looked at in parts of about so many for the words to count.
PART = 32
# Hosts of a part file of the tables with a row per host, and hosts whose words a task holds.
HOSTS = 64

# Elements and class words of what is not the article. Class words say nothing
# about the elements in SPARED, nor about a place that holds MASS of a host's text.
BOILERPLATE = frozenset(
    "aside button dialog footer form head header iframe menu nav noscript object script select "
    "style svg template textarea title".split()
)
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie "
    "cookies footer header menu nav navbar navigation newsletter notice notices popup promo "
    "related share sidebar social sponsor sponsored subscribe widget".split()
)
SPARED = frozenset("html body article main".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p "
    "pre section summary table tbody td tfoot th thead tr ul".split()
)
# Block elements that a new block inside them does not close.
CONTAINERS = BLOCKS - {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
# Elements closed by the next one of their kind.
SIBLINGS = frozenset("li dt dd td th tr option".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL,
)
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_places: dict[tuple[int, str, str], int] = {}


def place(parent: int, name: str, marks: str) -> int:
    """A number for an element by its chain of elements."""
    key = (parent, name, marks)
    found = _places.get(key)
    if found is None:
        if len(_places) > 200_000:
            _places.clear()
        found = xxhash.xxh64_intdigest(f"{name} {marks}", seed=parent) or 1
        _places[key] = found
    return found


@lru_cache(1 << 16)
def marked(attributes: str) -> str:
    """The words of class, id and role of a tag, without digits, sorted."""
    if "=" not in attributes:
        return ""
    found = " ".join(a or b or c for a, b, c in MARKS.findall(attributes))
    return " ".join(sorted(set(re.findall(r"[a-z]+", found.lower()))))


@lru_cache(1 << 16)
def hit(name: str, marks: str) -> bool:
    """Whether the class words of an element call it boilerplate."""
    return name not in SPARED and not BOILERPLATE_WORDS.isdisjoint(marks.split())


# How an element or text is boilerplate: by its class words or by its tag, or by both.
WORDED, TAGGED = 1, 2


def walk(
    page: str, spared: Collection[int] = (), words: bool = True
) -> Iterator[tuple[str, str, int, int, int, bool]]:
    """Events of a page: (kind, name or text, place, parent's place, boilerplate, hit).

    Kinds are open, close and text. Elements that are never closed end where the element
    around them ends, or where a block begins that cannot be inside them. Class words do not
    count at places in ``spared``, nor anywhere without ``words``.
    """
    # name, place, boilerplate, hit
    stack: list[tuple[str, int, int, bool]] = [("", 1, 0, False)]

    def pop():
        name, at, dull, found = stack.pop()
        return "close", name, at, stack[-1][1], dull, found

    at = 0
    while at < len(page):
        tag = MARKUP.search(page, at)
        stop = tag.start() if tag else len(page)
        if stop > at:
            yield "text", page[at:stop], stack[-1][1], 0, stack[-1][2], False
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if stack[-1][0] == name:
                yield pop()
            elif any(name == s[0] for s in stack[1:]):
                while stack[-1][0] != name:
                    yield pop()
                yield pop()
            continue
        if name in ("article", "main"):
            # An article is not part of boilerplate that was left open in front of it.
            while stack[-1][2] & TAGGED:
                yield pop()
        if name in BLOCKS:
            while stack[-1][0] and stack[-1][0] not in CONTAINERS:
                yield pop()
            if name in SIBLINGS and stack[-1][0] == name:
                yield pop()
        marks = marked(tag[3])
        up, dull = stack[-1][1], stack[-1][2]
        own = place(up, name, marks)
        found = hit(name, marks)
        if name in ("article", "main"):
            dull = 0
        if name in BOILERPLATE:
            dull |= TAGGED
        if found and words and signed(own) not in spared:
            dull |= WORDED
        yield "open", name, own, up, dull, found
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            yield "close", name, own, up, dull, found
        elif name not in VOID and not tag[3].endswith("/"):
            stack.append((name, own, dull, found))
    while len(stack) > 1:
        yield pop()


def word_place(own: int, before: str, word: str) -> int:
    """A number for a word by its element's place and the word before it."""
    return signed(xxhash.xxh64_intdigest(f"\n{before} {word}", seed=own))


def placed(events: Iterable[tuple]) -> Iterator[tuple]:
    """The events, each with the word that stands before it in its block, if any."""
    before = ""
    for event in events:
        kind, value, *_, dull, _ = event
        yield *event, before
        if kind != "text":
            if value in BLOCKS or value == "br":
                before = ""
        elif not dull & TAGGED:
            for last in WORD.findall(value)[-1:]:
                before = last


def word_places(own: int, before: str, text: str) -> Iterator[tuple[int, str]]:
    for word in WORD.findall(text):
        yield word_place(own, before, word), word
        before = word


def page_counts(
    page: str, words: dict[int, str] | None = None
) -> tuple[Counter, Counter, Counter, dict[int, tuple[str, int, bool, bool]]]:
    """Counts of the tokens (place, kind), text per place, and what the places are.

    Text is counted twice: all outside boilerplate tags, and of that what no element inside
    the place calls boilerplate by its class words. Place 0 stands for the page. Of the words
    only those in ``words`` are counted, with their element's place as their parent's.
    """
    some = set((words or {}).values())
    tokens, bulk, mass, known = Counter(), Counter(), Counter(), {}
    inside: list[tuple[int, bool]] = []
    for kind, value, own, up, dull, found, before in placed(walk(page)):
        if kind == "text":
            if some and not dull & TAGGED and not some.isdisjoint(WORD.findall(value)):
                for at, word in word_places(own, before, value):
                    if at in words:
                        tokens[at, "word"] += 1
                        known[at] = (word, own, False, False)
            if not dull & TAGGED and (size := len(value) - value.count(" ")):
                plain = True
                for each, worded in reversed(inside):
                    bulk[each] += size
                    if plain:
                        mass[each] += size
                    plain = plain and not worded
                bulk[0] += size
            continue
        tokens[own, kind] += 1
        known[own] = (value, up, bool(dull & TAGGED), found)
        if value in VOID or value in RAW:
            continue
        if kind == "open":
            inside.append((own, found))
        elif inside:
            inside.pop()
    return tokens, bulk, mass, known


def host(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.lower(url), F.lit("")), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


COUNTS = (
    "host string, place long, kind string, name string, up long, dull boolean, hit boolean, "
    "pages long, total long, low long, high long, bulk long, mass long"
)


def signed(number: int) -> int:
    return number - (1 << 64) if number >= 1 << 63 else number


def words_by_host(
    hosts: Iterable[str], words: pa.Array, known: dict[str, dict]
) -> Iterator[dict]:
    """The words of each row. Rows of a host share one map, which ``known`` holds."""
    for at, name in enumerate(hosts):
        if name not in known:
            if len(known) >= HOSTS:
                known.clear()
            known[name] = dict(words[at].as_py() or ())
        yield known[name]


def token_counts(pages: DataFrame) -> DataFrame:
    """Sums over pages of (host, key, html), combined per batch before the shuffle.

    Pages may have a map ``words`` of the words to count.
    """
    columns = ["host", "key", "html", *[c for c in pages.columns if c == "words"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in COUNTS.split(", ")]
        held: dict[str, dict] = {}
        for batch in batches:
            sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0, 0])
            hosts = batch.column(0).to_pylist()
            words = words_by_host(hosts, batch.column(3), held) if len(columns) > 3 else repeat({})
            for where, key, text, counted in zip(hosts, *batch.columns[1:3], words):
                key, text = key.as_py(), text.as_py()
                tokens, bulk, mass, known = page_counts(text, counted)
                tokens[0, "page"] = 1
                known[0] = ("", 0, False, False)
                chances: dict[int, int] = {}
                for (own, kind), n in tokens.items():
                    name, up, dull, found = known[own]
                    chance = chances.get(n)
                    if chance is None:
                        chance = chances[n] = xxhash.xxh64_intdigest(f"{key} {n}")
                    s = sums[where, signed(own), kind, name, signed(up), dull, found]
                    s[0] += 1
                    s[1] += n
                    s[2] += chance & 0xFFFFFFFF
                    s[3] += chance >> 32
                    if kind != "close":
                        s[4] += bulk[own]
                        s[5] += mass[own]
            rows = [(*k, *v) for k, v in sums.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    counted = pages.select(*columns).mapInArrow(run, COUNTS)
    keys = ["host", "place", "kind", "name", "up", "dull", "hit"]
    return counted.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("pages", "total", "low", "high", "bulk", "mass")]
    )


def likely(pages: Sequence[str], part: bool = False) -> dict[int, str]:
    """Words of the template of these pages.

    At least ``SUPPORT`` of the pages have them. Their vector is that of an element around them,
    or they stand in a row of ``CLASS_WORDS`` words with one vector; if the pages are not just
    ``part`` of their host's, at least two of them have such a row.
    """
    elements, words = defaultdict(list), defaultdict(list)
    parents, rows, n_pages = {}, [], Counter()
    for number, page in enumerate(pages):
        opened, found = Counter(), []
        for kind, value, own, up, dull, _, before in placed(walk(page)):
            if kind == "open":
                opened[own] += 1
                parents[own] = up
            elif kind == "text" and not dull & TAGGED:
                texts = WORD.findall(value)
                if texts:
                    found.append(list(zip(repeat(own), [before, *texts], texts)))
        for key, n in opened.items():
            elements[key].append((number, n))
        n_pages.update(set().union(*found))
        rows.append(found)
    often = {key for key, n in n_pages.items() if n >= SUPPORT * len(pages)}
    runs = []
    for number, found in enumerate(rows if often else ()):
        counts = Counter()
        for row in found:
            known = list(map(often.__contains__, row))
            if True in known:
                counts.update(compress(row, known))
                runs.append((row, known))
        for key, n in counts.items():
            words[key].append((number, n))
    out = set()
    for key in often:
        own = key[0]
        while own in parents:
            if elements[own] == words[key]:
                out.add(key)
                break
            own = parents[own]
    for row, known in runs:
        at = 0
        for vector, same in groupby(words[key] if here else None for key, here in zip(row, known)):
            n = len(list(same))
            if vector and n >= CLASS_WORDS and (part or len(vector) > 1):
                out.update(row[at : at + n])
            at += n
    return {word_place(*key): key[2] for key in out}


def likely_words(pages: DataFrame) -> DataFrame:
    """One row per host with several pages and words to count: host, words.

    From pages of (host, key, html, pages, marked). Small hosts with marked articles are left out.
    """
    several = (F.col("pages") >= EVIDENCE) | ((F.col("pages") > 1) & ~F.col("marked"))
    parts = F.greatest(F.lit(1), F.floor(F.col("pages") / PART))
    dealt = pages.where(several).select(
        "host", "html", "pages", F.pmod(F.xxhash64("key"), parts).alias("part")
    )
    schema = pa.schema([("host", pa.string()), ("place", pa.int64()), ("word", pa.string())])

    def run(part: pa.Table) -> pa.Table:
        several = part.column("pages")[0].as_py() > len(part)
        found = likely([value.as_py() for value in part.column("html")], several)
        hosts = [part.column("host")[0].as_py()] * len(found)
        return pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip((hosts, found.keys(), found.values()), schema)],
            schema=schema,
        )

    found = dealt.groupBy("host", "part").applyInArrow(run, "host string, place long, word string")
    each = found.groupBy("host", "place").agg(F.min("word").alias("word"))
    entries = F.map_from_entries(F.collect_list(F.struct("place", "word")))
    return each.groupBy("host").agg(entries.alias("words"))


def spare(tokens: list[dict], bulk: int) -> dict[int, dict]:
    """Places that class words call boilerplate, but that hold most of the host's text."""
    return {
        t["place"]: t
        for t in tokens
        if t["kind"] == "open" and t["hit"] and not t["dull"] and t["bulk"] >= MASS * max(bulk, 1)
    }


def nest(
    tokens: list[dict], pages: int, bulk: int
) -> tuple[list[dict], list[int], list[int], list[tuple[int, str]]]:
    """The template of a host, its regions, spared places and words, from its valid tokens.

    The template lists elements with the number of their class and the nearest element
    around them that is in the template too.
    """
    vectors = defaultdict(list)
    for t in tokens:
        vectors[t["low"], t["high"], t["pages"]].append(t)
    template: dict[int, dict] = {}
    for number, (_, members) in enumerate(sorted(vectors.items())):
        kinds = defaultdict(set)
        for t in members:
            kinds[t["place"]].add(t["kind"])
        for t in members:
            if t["kind"] == "open" and kinds[t["place"]] == {"open", "close"}:
                template[t["place"]] = t | {"number": number}
    places = {t["place"]: t for t in tokens if t["kind"] != "word"}
    out = []
    for own, t in sorted(template.items()):
        up = t["up"]
        while up in places and up not in template:
            up = places[up]["up"]
        around = up if up in template else 0
        out.append({"place": own, "parent": around, "number": t["number"], "name": t["name"]})
    spared = spare(tokens, bulk)

    def chain(t: dict | None) -> Iterator[dict]:
        while t:
            yield t
            t = places.get(t["up"])

    def vector(t: dict) -> tuple[int, int, int]:
        return t["low"], t["high"], t["pages"]

    # Words, and whether they need others of their class beside them.
    alike = Counter((t["up"], *vector(t)) for t in tokens if t["kind"] == "word")
    fixed = []
    for t in sorted((t for t in tokens if t["kind"] == "word"), key=lambda t: t["place"]):
        around = any(
            each["place"] in template and vector(template[each["place"]]) == vector(t)
            for each in chain(places.get(t["up"]))
        )
        if around or alike[t["up"], *vector(t)] >= CLASS_WORDS:
            fixed.append((t["place"], "" if around else "row"))

    def dull(t: dict) -> bool:
        for each in chain(t):
            if each["dull"] or (each["hit"] and each["place"] not in spared):
                return True
            if each["name"] in ("article", "main"):
                return False
        return False

    # What a spared place holds counts in the places around it too.
    held = Counter({t["place"]: t["mass"] for t in tokens if t["kind"] == "open"})
    for t in spared.values():
        for each in list(chain(t))[1:]:
            held[each["place"]] += t["mass"]
    single = [t for t in template.values() if t["total"] == t["pages"] and not dull(t)]
    for name in ("article", "main"):
        regions = sorted(t["place"] for t in single if t["name"] == name)
        if regions:
            return out, regions, sorted(spared), fixed
    most = max((held[t["place"]] for t in single), default=0)
    heavy = [t for t in single if held[t["place"]] and held[t["place"]] >= MASS * most]
    if not heavy:
        return out, [], sorted(spared), fixed
    best = min(heavy, key=lambda t: (held[t["place"]], t["place"]))
    return out, [best["place"]], sorted(spared), fixed


WORDS = pa.map_(pa.int64(), pa.string())

TEMPLATE = (
    "host string, pages long, "
    "template array<struct<place:long,parent:long,number:int,name:string>>, "
    "regions array<long>, spared array<long>, words map<bigint,string>"
)


def templates(counts: DataFrame) -> DataFrame:
    """One row per host: host, pages, template, regions, spared, words.

    Only tokens that half of the pages have come together here, so a host has at most
    twice as many as an average page. ``counts`` is read twice and should be a written table.
    """
    sizes = counts.where("kind = 'page'").select(
        "host", F.col("pages").alias("all_pages"), F.col("bulk").alias("all_bulk")
    )
    valid = counts.where("kind != 'page'").join(sizes, "host").where(
        F.col("pages") >= SUPPORT * F.col("all_pages")
    )

    def deduce(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        template, regions, spared, words = nest(rows, rows[0]["all_pages"], rows[0]["all_bulk"])
        row = {
            "host": rows[0]["host"],
            "pages": rows[0]["all_pages"],
            "template": template,
            "regions": regions,
            "spared": spared,
            "words": words,
        }
        return pa.Table.from_pylist([row], schema=schema)

    schema = pa.schema(
        [
            ("host", pa.string()),
            ("pages", pa.int64()),
            (
                "template",
                pa.list_(
                    pa.struct(
                        [
                            ("place", pa.int64()),
                            ("parent", pa.int64()),
                            ("number", pa.int32()),
                            ("name", pa.string()),
                        ]
                    )
                ),
            ),
            ("regions", pa.list_(pa.int64())),
            ("spared", pa.list_(pa.int64())),
            ("words", WORDS),
        ]
    )
    return valid.groupBy("host").applyInArrow(deduce, TEMPLATE)


def blocks(
    page: str,
    regions: Iterable[int],
    names: Iterable[str],
    spared: Collection[int] = (),
    words: bool = True,
    fixed: Mapping[int, str] | None = None,
    least: int = 1,
    share: float = 1.0,
) -> list[str]:
    """Texts of the blocks inside the regions, or inside elements of some names.

    Without runs of ``least`` or more words in ``fixed``, unless these are more than this
    share of all words, or all.
    """
    regions, names = set(regions), set(names)
    found: list[str] = []
    slots: list[str] = []
    block: list[str] = []
    slot: list[str] = []
    n_words, n_fixed = 0, 0
    deep = 0

    def end() -> None:
        for pieces, texts in ((block, found), (slot, slots)):
            text = SPACE.sub(" ", references.unescape("".join(pieces))).strip(" ")
            pieces.clear()
            if text:
                texts.append(text)

    events = walk(page, spared, words)
    for kind, value, own, _, dull, _, before in placed(events) if fixed else (
        (*event, "") for event in events
    ):
        if kind == "text":
            if deep and not dull:
                block.append(value)
                if fixed:
                    places = [at for at, _ in word_places(own, before, value)]
                    gone = in_runs([fixed.get(at) for at in places], least)
                    n_words += len(gone)
                    n_fixed += sum(gone)
                    if any(gone):
                        each = iter(gone)
                        value = WORD.sub(lambda m: "" if next(each) else m[0], value)
                    slot.append(value)
            continue
        if value in BLOCKS:
            end()
        elif value == "br":
            block.append(" ")
            slot.append(" ")
        if (signed(own) in regions or value in names) and value not in VOID:
            if kind == "open" and not dull:
                deep += 1
            elif kind == "close" and deep and not dull:
                deep -= 1
    end()
    return slots if 0 < n_fixed <= share * n_words and slots else found


def in_runs(marks: list[str | None], least: int) -> list[bool]:
    """Which words of a text are in the template.

    They stand in a run of ``least`` template words, and of ``CLASS_WORDS`` if all of the run are
    classes of their own.
    """
    out = []
    for known, run in groupby(marks, lambda mark: mark is not None):
        run = list(run)
        need = max(least, 1 if "" in run else CLASS_WORDS)
        out += [known and len(run) >= need] * len(run)
    return out


def main_text(
    page: str,
    regions: Iterable[int],
    spared: Iterable[int] = (),
    fixed: Mapping[int, str] | None = None,
    least: int = 1,
    share: float = 0.5,
) -> str:
    """The text of the regions, else of what may stand for them, as far as a page has any.

    Class words are left out at last, so that only a page whose text is all in boilerplate
    tags gives an empty text.
    """
    spared, whole_page = set(spared), f"<body>{page}"
    for words in (True, False):
        for where, names in ((regions, ()), ((), ("article",)), ((), ("main",)), ((), ("body",))):
            if where or names:
                found = blocks(page, where, names, spared, words, fixed, least, share)
                if found:
                    return "\n".join(found)
        found = blocks(whole_page, (), ("body",), spared, words, fixed, least, share)
        if found:
            return "\n".join(found)
    return ""


def page_texts(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Per page: page_id, url, text."""
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        host(F.col(url)).alias("host"),
        whole(html).alias("html"),
    )
    key = F.concat_ws(" ", F.col("page_id").cast("string"), "url")
    rows = rows.withColumn("key", key)
    marks = F.rlike("html", F.lit(r"(?i)<(article|main)[\s>/]"))
    sizes = written(
        rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.max(marks).alias("marked")),
        "hosts",
    )
    spread = ["page_id", "url"]
    parts = max(1, -(-sizes.count() // HOSTS))
    words = likely_words(spread_join(rows, sizes, "host", "pages", spread))
    worded = written(sizes.join(words, "host", "left").coalesce(parts), "hosts")
    counts = written(token_counts(spread_join(rows, worded, "host", "pages", spread)), "tokens")
    found = templates(counts).select("host", "pages", "regions", "spared", "words")
    known = written(found.join(sizes.select("host", "marked"), "host").coalesce(parts), "templates")
    joined = spread_join(rows, known, "host", "pages", spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for batch in batches:
            hosts, where, kept, n, marked = (
                batch.column(i).to_pylist() for i in (8, 3, 4, 6, 7)
            )
            fixed = words_by_host(hosts, batch.column(5), held)
            texts = [
                main_text(
                    page.as_py(), where or (), kept or (), fixed,
                    -(-EVIDENCE // (n or 1)), 0.5 if marked else 1.0,
                )
                for page, where, kept, fixed, n, marked in zip(
                    batch.column(2), where, kept, fixed, n, marked
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )

    wanted = joined.select(
        "page_id", "url", "html", "regions", "spared", "words", "pages", "marked", "host"
    )
    schema = rows.select("page_id", "url", F.col("html").alias("text")).schema
    return wanted.mapInArrow(run, schema)


def text_table(pages: DataFrame) -> DataFrame:
    return page_texts(pages).withColumn("n_chars", F.char_length("text").cast("long"))
