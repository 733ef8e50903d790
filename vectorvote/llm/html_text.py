"""Main text of web pages by nearest-URL page differencing.

Each page becomes lines: one for each block, with its structural path.  Pages are ordered by host and URL path, and each is compared with
the NEAR pages before and behind it on the same host: the lines are aligned by longest common subsequence, and a line that most of
these pages have in the same place is template, and goes.  Pages with equal lines are copies of one page: neighbours in the
order count as one, and a copy has no vote on its copies.

What an element is called comes second.  Lines under a landmark (menu, header, footer, sidebar, form ...) and under an element whose class,
id or role says so (advert, notice, comments ...) are slots, whose words differ from page to page: they align by their path alone,
and are never main text.  A line under article, main or role=main stays where the votes are even, or there is one only; other
lines go.  Of what is left, lines of the marked article are the main text, unless the lines outside it have more characters.

The order is range-partitioned, so a host with very many pages is spread over tasks.  The pages at the ends of partitions
meet their neighbours in further passes over those ends.  Copies that fill whole partitions are compared with what their partition holds.

Defined results: null or empty html has empty text.  A null url, or one without a host, is on the host "".  Pages of equal URL
are ordered by page_id, then by a hash of the html; repeated rows are copies.  Tags that are never closed end where their parent ends;
elements deeper than DEEPEST belong to the element at that depth, as in browsers; cut-off tags and unknown references are text as
a browser would show it.  Parsing takes time in proportion to the page.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import kept
from .text import as_table, slices

#: Fixed values of HTML: elements without content of their own, elements whose content is no text, and elements within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math select object audio video canvas head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rtc rp s samp small span strike strong sub sup time tt u var wbr img".split())
LANDMARKS = frozenset("nav header footer aside form dialog menu button fieldset".split())
#: Words in class, id or role that mark what is not the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs"
    " header masthead footer sidebar side aside widget notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social related recommended comment comments commentlist disqus reply replies respond reader search form toolbar pagination pager skip"
    " complementary contentinfo dialog".split()
)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MAIN, TEMPLATE, PLAIN = 2, 1, 0
#: Pages on each side that a page is compared with; depth of elements; and pages that one task compares in the passes over ends, about.
NEAR, DEEPEST, END_PAGES = 3, 256, 20_000


class Line:
    __slots__ = ("text", "path", "kind")

    def __init__(self, text: str, path: int, kind: int):
        self.text, self.path, self.kind = text, path, kind


#: Words before a hint that say the element only goes with such a thing; elements that hints can't exclude; and hints that name parts of an article.
_GOES_WITH = frozenset("no not has have with without hide".split())
_WHOLE = frozenset("html body main article".split())
_IN_ARTICLE = frozenset("header masthead side reader search form skip".split())


def _says(name: str, attributes: str, kind: int) -> tuple[bool, bool, str]:
    """Whether an element's attributes mark it as no article, whether as the main part, and its classes for the path."""
    template, main, names = bool(_HIDDEN.search(attributes)), False, []
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        names.append(value)
        main |= m[1].lower() == "role" and value.lower() == "main"
        if name in _WHOLE:
            continue
        for token in value.split():
            words = [w.lower() for w in _WORD.findall(token)]
            for k, w in enumerate(words):
                if w in HINTS and not (k and words[k - 1] in _GOES_WITH) and not (kind == MAIN and w in _IN_ARTICLE):
                    template = True
    return template, main, "." + ".".join(names) if names else ""


def _hash(raw: str) -> int:
    return int.from_bytes(hashlib.blake2b(raw.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Open:
    """The open elements: name, hash of the path, and kind of each."""

    def __init__(self):
        self.stack: list[tuple[str, int, int]] = [("", 0, PLAIN)]
        self.count: Counter = Counter()
        self.beyond: Counter = Counter()

    def push(self, name: str, path: int, kind: int) -> None:
        if len(self.stack) > DEEPEST:
            self.beyond[name] += 1
        else:
            self.stack.append((name, path, kind))
            self.count[name] += 1

    def cut(self, k: int) -> None:
        for name, _, _ in self.stack[k:]:
            self.count[name] -= 1
        del self.stack[k:]

    def last(self, name: str) -> int:
        """Where the innermost element of a name is; 0 if there is none."""
        k = len(self.stack) - 1 if self.count[name] > 0 else 0
        while k and self.stack[k][0] != name:
            k -= 1
        return k

    def close(self, names: tuple, barriers: frozenset) -> None:
        """Ends the innermost open element of these names, unless a barrier stands between."""
        if any(self.count[n] > 0 for n in names):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in names:
                    return self.cut(k)
                if self.stack[k][0] in barriers:
                    return None
        return None


_P_BARRIERS = frozenset("table button object article main section div body".split())
_ITEM_BARRIERS = frozenset("ul ol dl table select".split())


def lines(page: str | None) -> list[Line]:
    """The text lines of a page, in page order, with their structural path and kind."""
    out: list[Line] = []
    opened = _Open()
    stack = opened.stack
    text: list[str] = []

    def flush() -> None:
        joined = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if joined:
            # the line belongs to the innermost block
            k = len(stack) - 1
            while stack[k][0] in INLINE:
                k -= 1
            out.append(Line(joined, stack[k][1], stack[k][2]))

    page = page or ""
    at, size = 0, len(page)
    ahead: dict[str, tuple[int, int]] = {}

    def search(pattern: str) -> tuple[int, int]:
        """Where a pattern is found next, from `at` on: each stretch of the page is searched once."""
        found = ahead.get(pattern)
        if found is None or found[0] < at:
            m = re.compile(pattern, re.I).search(page, at)
            found = ahead[pattern] = m.span() if m else (size + 1, size + 1)
        return found

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][:2] not in ("<!", "<?") or m[0].startswith("<![CDATA["):
                text.append(m[0])
            continue
        name = name.lower()
        if m[1]:
            if opened.beyond[name] > 0:
                opened.beyond[name] -= 1
                continue
            k = opened.last(name)
            if not k and name not in INLINE or any(x[0] not in INLINE for x in stack[k:] if k):
                flush()
            if k:
                opened.cut(k)
            continue
        if name in RAW:
            if name in ("svg", "math") and m[3].rstrip().endswith("/"):
                continue
            start, end = search(rf"</{name}\s*(?:/?>|\Z)")
            if name == "head":  # a head that is never closed ends where the body begins
                body = search(r"<body\b")[0]
                at = end if start < body else body if body <= size else at
            else:
                at = min(end, size)
            continue
        if name == "br" or name == "hr":
            text.append(" ")
        if name in VOID:
            continue
        if name not in INLINE:
            flush()
            if name in _ENDS_P:
                opened.close(("p",), _P_BARRIERS)
            if name in _CLOSES:
                opened.close(_CLOSES[name], _ITEM_BARRIERS)
        _, path, kind = stack[-1]
        template, main, names = _says(name, m[3], kind) if m[3] else (False, False, "")
        if kind != TEMPLATE:
            if template or name in LANDMARKS and not (name == "header" and kind == MAIN):
                kind = TEMPLATE
            elif name in ("article", "main") or main:
                kind = MAIN
        opened.push(name, _hash(f"{path}/{name}{names}") if name not in INLINE else path, kind)
    flush()
    return out


def common(a: list[int], b: list[int]) -> set[int]:
    """The places of `a` in one longest common subsequence of a and b: bit-parallel, halving long inputs (Hirschberg)."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ha, hb = len(a), len(b)
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    out = set(range(lo)) | set(range(ha, len(a)))
    x, y = a[lo:ha], b[lo:hb]
    if not x or not y:
        return out
    if len(x) == 1:
        return out | ({lo} if x[0] in y else set())
    if len(x) * len(y) > 1 << 26:
        half = len(x) // 2
        left = _scores(x[:half], y)
        right = _scores(x[half:][::-1], y[::-1])[::-1]
        cut = int(np.argmax(left + right))
        return out | {lo + k for k in common(x[:half], y[:cut])} | {lo + half + k for k in common(x[half:], y[cut:])}
    rows = _rows(y, x)
    i, j = len(x), len(y)
    while i and j:  # bit j-1 of row i is 0 where the score grows at column j
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.add(lo + i)
    return out


def _rows(y: list[int], x: list[int]) -> list[int]:
    """Bit vectors of the score rows: row i has a 0 at column j where lcs(x[:i], y[:j+1]) exceeds lcs(x[:i], y[:j])."""
    masks: dict[int, int] = {}
    for j, key in enumerate(y):
        masks[key] = masks.get(key, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, out = full, [full]
    for key in x:
        m = masks.get(key, 0)
        hit = row & m
        row = ((row + hit) | (row - hit)) & full
        out.append(row)
    return out


def _scores(x: list[int], y: list[int]) -> np.ndarray:
    """lcs(x, y[:j]) for each j."""
    row = _rows(y, x)[-1]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _key(line: Line) -> int:
    return line.path if line.kind == TEMPLATE else _hash(f"{line.path}\n{line.text}")


def main_lines(size: list[int], kind: list[int], key: list[int], others: list[list[int]]) -> list[int]:
    """The places of a page's main lines, given the keys of the pages near it."""
    votes, n = Counter(), len(others)
    for other_key in others:
        votes.update(common(key, other_key))
    left = []
    for k, own in enumerate(kind):
        if own == PLAIN and votes[k] * 2 < max(n, 1) or own == MAIN and (votes[k] < n or n < 3):
            left.append(k)
    marked, plain = ([k for k in left if kind[k] == x] for x in (MAIN, PLAIN))
    return marked if marked and sum(size[k] for k in marked) >= sum(size[k] for k in plain) else plain


_ROW = "page_id bigint, url string, host string, path string, tie bigint, texts binary, kinds binary, keys array<bigint>"
_SCHEMA = f"{_ROW}, text string, open boolean"
_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("tie", pa.int64())]
    + [("texts", pa.binary()), ("kinds", pa.binary()), ("keys", pa.list_(pa.int64())), ("text", pa.string()), ("open", pa.bool_())]
)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each page, packed: the texts of those that may be main text, compressed; the kinds and keys of all."""
    import zstandard

    schema = pa.schema([f for f in _ARROW if f.name not in ("text", "open")])
    packer = zstandard.ZstdCompressor(level=9)
    for whole in batches:
        for batch in slices(whole, "html", 1 << 20):
            texts, kinds, keys = [], [], []
            for page in batch.column("html"):
                found = lines(page.as_py())
                texts.append(packer.compress("\n".join(x.text for x in found if x.kind != TEMPLATE).encode("utf-8", "replace")))
                kinds.append(bytes(x.kind for x in found))
                keys.append([_key(x) for x in found])
            yield as_table(schema, **{c: batch.column(c) for c in ("page_id", "url", "host", "path", "tie")}, texts=texts, kinds=kinds, keys=keys)


class _Page:
    """A page and the copies that follow it in the order; `rows` are those whose text is still wanted."""

    def __init__(self, row: dict):
        self.row, self.rows = row, []
        self.own = tuple(k for k, kind in zip(row["keys"], row["kinds"]) if kind != TEMPLATE)

    def text(self, near: list[_Page]) -> str:
        import zstandard

        packed = zstandard.ZstdDecompressor().decompress(self.row["texts"], max_output_size=1 << 31).decode()
        rest = iter(packed.split("\n"))
        texts = ["" if kind == TEMPLATE else next(rest) for kind in self.row["kinds"]]
        others = [x.row["keys"] for x in near if x.row["host"] == self.row["host"] and x.own != self.own]
        return " ".join(texts[k] for k in main_lines([len(t) for t in texts], list(self.row["kinds"]), self.row["keys"], others))

    def done(self, near: list[_Page]) -> list[dict]:
        text = self.text(near) if self.rows else ""
        return [{"page_id": i, "url": url, "text": text, "open": None} for i, url, _ in self.rows]

    def end(self, wanted: bool) -> list[dict]:
        """The page as a row of the next pass: all its rows if their text is still wanted, else one as a neighbour of others."""
        if not wanted or not self.rows:
            return [self.row | {"text": None, "open": False}]
        return [self.row | {"page_id": i, "url": url, "tie": tie, "text": None, "open": True} for i, url, tie in self.rows]


def _emit(rows: list[dict]) -> pa.RecordBatch:
    return as_table(_ARROW, **{f.name: [r.get(f.name) for r in rows] for f in _ARROW})


def _compared(last: bool):
    """Texts (open is null) of the pages of a sorted partition.  Unless it is the last pass, the NEAR pages at each of its ends stay
    open, and they and as many beside them go to the next pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: list[_Page] = []  # those before the one that is next, and it, and those behind it
        at = number = 0  # the place in `pages` of the one that is next; and its number in the partition
        head: list[_Page] = []
        out: list[dict] = []

        def step() -> None:
            nonlocal at, number
            page = pages[at]
            if last or number >= NEAR:
                out.extend(page.done(pages[max(0, at - NEAR) : at] + pages[at + 1 : at + 1 + NEAR]))
                page.rows = []
            at, number = at + 1, number + 1
            if at > 2 * NEAR:
                del pages[0]
                at -= 1

        for batch in batches:
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                for row in part.to_pylist():
                    wanted = row.pop("open", True)
                    page = _Page(row)
                    if not pages or pages[-1].own != page.own or pages[-1].row["host"] != row["host"]:
                        pages.append(page)
                        if len(head) < 2 * NEAR:
                            head.append(page)
                        while len(pages) - at > NEAR + 1:
                            step()
                    if wanted:
                        pages[-1].rows.append((row["page_id"], row["url"], row["tie"]))
                if out:
                    yield _emit(out)
                    out = []
        if last:
            while at < len(pages):
                step()
        else:
            tail = pages[-2 * NEAR :]
            open_ = {id(x) for x in head[:NEAR]} | {id(x) for x in pages[-NEAR:]}
            while at < len(pages):  # what is neither near the beginning nor near the end
                if number >= NEAR and id(pages[at]) not in open_:
                    out.extend(pages[at].done(pages[max(0, at - NEAR) : at] + pages[at + 1 : at + 1 + NEAR]))
                    pages[at].rows = []
                at, number = at + 1, number + 1
            for page in [*head, *(x for x in tail if all(x is not y for y in head))]:
                out.extend(page.end(id(page) in open_))
        if out:
            yield _emit(out)

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text, a row for each page."""
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = F.lower(F.regexp_extract(bare, r"^//([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?://[^/?#]*)?([^?#]*)", 1), r"(?:index)?(?:\.html?)?/?$", "")
    source = pages.select("page_id", "url", host.alias("host"), path.alias("path"), F.xxhash64("html").alias("tie"), "html")
    order = ("host", "path", "page_id", "tie")
    rows = source.mapInArrow(_parsed, _ROW).repartitionByRange(*order)
    found, before, last = [], None, False
    while True:
        got = kept(rows.sortWithinPartitions(*order).mapInArrow(_compared(last), _SCHEMA), "pages")
        found.append(got.where("open is null").select("page_id", "url", "text"))
        if last:
            break
        ends = got.where("open is not null")
        n = ends.count()
        parts = max(1, -(-n // END_PAGES))
        last = parts == 1 or before is not None and 2 * n > before  # copies that fill partitions don't become fewer
        before = n
        ends = ends.drop("text")
        rows = ends.repartition(1) if parts == 1 else ends.repartitionByRange(parts, *order)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page; see the module for cases."""
    got = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


QUERIES: dict[str, Callable] = {"op2_html_text": op2_html_text}
