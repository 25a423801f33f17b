"""Main text of web pages, by differencing pages of near URLs.

Pages are put in order by host and URL path; pages of a host with equal lines are one, at the least of their paths. Up
to two pages before and two after a page on its host are near it. The text lines (blocks) of both are aligned by a
longest common subsequence. The nearest (by common path) is the page's pair, and lines shared with it go: what pages of
one part of a site have in common is the site's, not the page's. Of the text that is not shared with all near pages of
a path as near, a copy of the article has more than half; it is no pair. Lines inside <article> or <main>
stay: headlines and first paragraphs that several articles share are theirs all the same.

Differencing cannot see menus, notices and adverts whose text changes from page to page. Elements that hold no main text
by their name go with all that they hold (nav, aside, script, ...). Forms, and elements whose class, id or role says so,
go too, but not where they hold most of a page that has no article outside of them: then their lines are the
differencing's to judge.

Null html gives an empty text. Null or broken URLs have no near pages. Repeated pages each get a row. Truncated pages
are read as far as they go; very long pages take memory in proportion to their length. An empty table gives no row;
other columns are ignored. Reruns agree: ties go to the page before.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from itertools import takewhile

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigframe.llm.common import cut, partitions, pieces, read
from sigframe.llm.components import spread_join

#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no main text, and words of a class, id or role that say the same.
APART = frozenset("aside button canvas datalist dialog footer head iframe map menu nav noscript object search select svg template textarea title video audio".split())
SAYS_APART = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies respond related recommended share sharing social toolbar widget "
    "widgets skip pagination pager complementary contentinfo dialog hidden".split()
)
RAW = "script|style|noscript|template|iframe|textarea|title|xmp"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?P<rawattr>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attr2>[^>]*+)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORDS = re.compile(r"[a-z]+")


#: Near pages on either side of a page, and what share of a page's own text its copies have.
NEAR = 2
COPY = 0.5
#: Pages that a task goes through at a time.
STRETCH = 4096


def _marks(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is apart from the main text by name or because it is hidden, whether it says so by a class,
    id or role, and whether it is the article."""
    apart, says, own = name in APART, name == "form", name in ("article", "main")
    if attributes and "=" in attributes or "hidden" in attributes:
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id", "role"):
                words = set(WORDS.findall(value))
                says = says or name not in ("html", "body", "main") and bool(words & SAYS_APART)
                own = own or key == "role" and value == "main"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                apart = apart or key != "hidden" or not value or value == "hidden"
    return apart, says, own


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """The blocks of a page in order: text, whether it stands apart from the main text, whether in the article."""
    out: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # the last: elements around that say that they are apart
    held: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    said: list[int] = []
    apart = article = number = 0
    at = 0

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            out.append((text, apart > 0, article > 0, tuple(said)))

    for token in TOKEN.finditer(page):
        if token.start() > at:
            held.append(page[at : token.start()])
        at = token.end()
        name = token["name"] or token["name2"]
        if token["raw"]:
            if token["raw"].lower() == "title":
                close()
            continue
        if not name:
            continue
        name = name.lower()
        if name in BLOCK:
            close()
        if token["end"] or token["end2"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(any(s[1:]) or s[0] in BLOCK for s in stack[i:]):
                        close()
                    for _, a, b, c in stack[i:]:
                        apart -= a
                        article -= c
                        if b:
                            said.pop()
                    del stack[i:]
                    break
        elif name not in VOID:
            a, b, c = _marks(name, token["attr"] or token["attr2"] or "")
            if name == "header" and not article:
                a = True
            if a or b or c:
                close()
            stack.append((name, a, b, c))
            apart += a
            article += c
            if b:
                number += 1
                said.append(number)
    if at < len(page):
        held.append(page[at:])
    close()
    return [(t, a or bool(s), b) for t, a, b, s in _believed(out)]


def _believed(found: list[tuple[str, bool, bool, tuple[int, ...]]]) -> list[tuple[str, bool, bool, tuple[int, ...]]]:
    """The blocks without elements that say that they are apart and yet hold most of a page's text, the outermost
    first, as long as no article stands outside of all such elements."""
    while True:
        shown = [(len(t), b, s) for t, a, b, s in found if not a]
        if not any(s for _, _, s in shown) or any(b and not s for _, b, s in shown):
            return found
        held: dict[int, int] = {}
        for n, _, s in shown:
            if s:
                held[s[0]] = held.get(s[0], 0) + n
        most = max(held, key=held.get)
        if 2 * held[most] <= sum(n for n, _, _ in shown):
            return found
        found = [(t, a, b, s[1:] if s and s[0] == most else s) for t, a, b, s in found]


# ---- longest common subsequence ------------------------------------------------------------------


def _states(a: Sequence, b: Sequence) -> Iterator[int]:
    """For each beginning of a, a number whose zero bits are where the subsequence with b's beginnings grows."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    state = every
    yield state
    for x in a:
        match = where.get(x, 0)
        common = state & match
        state = (state + common | state - common) & every
        yield state


def common(a: Sequence, b: Sequence, most: int = 1 << 27) -> list[int]:
    """Positions in a of a longest common subsequence with b. Bits for all pairs of positions are kept up to `most`;
    beyond, a is halved at the best place of b, so that memory stays linear."""
    if not a or not b:
        return []
    front = sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(a, b)))
    if front:
        return [*range(front), *(front + i for i in common(a[front:], b[front:], most))]
    if len(a) * len(b) <= most:
        rows = list(_states(a, b))
        i, j, out = len(a), len(b), []
        while i and j:
            if rows[i] >> (j - 1) & 1:  # no growth at j
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:  # it had grown before
                i -= 1
            else:
                out.append(i - 1)
                i, j = i - 1, j - 1
        return out[::-1]
    half = len(a) // 2
    ahead = behind = 0
    for ahead in _states(a[:half], b):
        pass
    for behind in _states(a[half:][::-1], b[::-1]):
        pass
    n = len(b)
    grows = np.array([not ahead >> j & 1 for j in range(n)])
    after = np.array([not behind >> j & 1 for j in range(n)])
    split = int((np.concatenate(([0], np.cumsum(grows))) + np.concatenate(([0], np.cumsum(after)))[::-1]).argmax())
    return common(a[:half], b[:split], most) + [half + i for i in common(a[half:], b[split:], most)]


def path_alike(a: str, b: str) -> int:
    return sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(a, b)))


def numbered(found: Sequence[tuple[str, bool, bool]]) -> list[int]:
    """A number for each line: equal for equal lines of one kind; the last bits are its kind (apart, in the article)
    and, above them, its length up to 4095."""
    return [(xxhash.xxh3_64_intdigest(t) << 14 & (1 << 63) - 1 | min(len(t), 4095) << 2 | a << 1 | b) for t, a, b in found]


def judged(own: Sequence[int], path: str, near: Sequence[tuple[str, Sequence[int]]]) -> list[bool]:
    """Whether each line of a page goes, by its near pages (path and lines) in their order of preference."""
    gone = [False] * len(own)
    if not near:
        return gone
    size = [(x >> 2 & 4095) * (not x & 2) for x in own]
    shared = [common(own, other) for _, other in near]
    share = [sum(size[i] for i in s) for s in shared]
    alike = [path_alike(path, p) for p, _ in near]
    least = [min(s for s, a in zip(share, alike) if a >= own_a) for own_a in alike]
    copies = [s - m > COPY * (sum(size) - m) for s, m in zip(share, least)]
    if all(copies):
        return gone
    pair = max((i for i in range(len(near)) if not copies[i]), key=lambda i: (alike[i], -i))
    for i in shared[pair]:
        gone[i] = not own[i] & 1
    return gone


# ---- the operator ---------------------------------------------------------------------------------


def _located(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"), path.alias("path"))


def shared_lines(read_lines: DataFrame) -> DataFrame:
    """host, lh, gone (a byte for each line, 1 where it goes) for each distinct page of rows (host, path, lh, lines)."""
    spark = read_lines.sparkSession
    n = partitions(spark)
    one = read_lines.filter("host is not null and size(lines) > 0").groupBy("host", "lh").agg(F.min("path").alias("path"), F.first("lines").alias("lines"))
    # A place in the order: a partition's rows are numbered, and the few partitions' counts are summed.
    placed = cut(one.repartitionByRange(n, "host", "path", "lh").sortWithinPartitions("host", "path", "lh").withColumn("m", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("m", 33)).withColumn("i", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = placed.join(before, "part").select("host", "path", "lh", "lines", (F.col("before") + F.col("i")).alias("rank"))
    # Stretches of the order, each with the pages next to it.
    ranked = ranked.withColumn("stretch", F.explode(F.expr(f"array_distinct(transform(array(rank - {NEAR}, rank, rank + {NEAR}), x -> greatest(0L, x) div {STRETCH}L))")))
    dealt = ranked.repartition(n, "stretch").sortWithinPartitions("stretch", "rank")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: list[tuple] = []  # of one stretch: rank, host, path, lh, lines
        now, first = None, 0

        def one_page(i: int) -> tuple | None:
            rank, host, path, lh, own = window[i]
            if rank // STRETCH != now:
                return None
            beside = [j for d in range(1, NEAR + 1) for j in (i - d, i + d) if 0 <= j < len(window) and window[j][1] == host]
            return host, lh, bytes(judged(own, path, [window[j][2::2] for j in beside]))

        def told(some: list) -> pa.RecordBatch:
            host, lh, gone = zip(*some) if some else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(lh, pa.int64()), pa.array(gone, pa.binary())], ["host", "lh", "gone"])

        for batch in batches:
            out = []
            for stretch, *page in zip(*(batch.column(c).to_pylist() for c in ("stretch", "rank", "host", "path", "lh", "lines"))):
                if stretch != now:
                    out += [one_page(i) for i in range(first, len(window))]
                    window, now, first = [], stretch, 0
                window.append(tuple(page))
                if len(window) - first > NEAR:
                    out.append(one_page(first))
                    first += 1
                    if first > NEAR:
                        del window[: first - NEAR]
                        first = NEAR
            yield told([x for x in out if x])
        yield told([x for x in (one_page(i) for i in range(first, len(window))) if x])

    return dealt.select("stretch", "rank", "host", "path", "lh", "lines").mapInArrow(compare, "host string, lh bigint, gone binary")


def extract(pages: DataFrame, differencing: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared for each row of pages(page_id, url, html)."""
    located = _located(pages)
    kinds = dict(pages.dtypes)
    own = f"page_id {kinds['page_id']}, url {kinds['url']}"

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in pieces(batches):
            found = [numbered(lines(p)) for p in some.column("html").to_pylist()]
            lh = [xxhash.xxh3_64_intdigest(np.array(x, np.int64).tobytes()) - (1 << 63) for x in found]
            yield pa.RecordBatch.from_arrays([some.column("host"), some.column("path"), pa.array(lh, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["host", "path", "lh", "lines"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for some in pieces(batches):
            found = [lines(p) for p in some.column("html").to_pylist()]
            lh = [xxhash.xxh3_64_intdigest(np.array(numbered(x), np.int64).tobytes()) - (1 << 63) for x in found]
            made = [press.compress("\n".join(f"{a + 2 * b}{t}" for t, a, b in x).encode("utf-8", "surrogatepass")) for x in found]
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("page_id", "url", "host")), pa.array(lh, pa.int64()), pa.array(made, pa.binary())], ["page_id", "url", "host", "lh", "packed"])

    # What is shuffled is the lines, compressed: less than half of the pages.
    joined = located.mapInArrow(packed, f"{own}, host string, lh bigint, packed binary")
    near = shared_lines(located.select("host", "path", "html").mapInArrow(numbers, "host string, path string, lh bigint, lines array<bigint>"))
    joined = spread_join(joined, near, ["host", "lh"], ["page_id", "url"], "left") if differencing else joined.withColumn("gone", F.lit(None).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, counts, shared = [], [], []
            for page, gone in zip(batch.column("packed").to_pylist(), batch.column("gone").to_pylist()):
                found = [(x[1:], int(x[0]) & 1) for x in unpress.decompress(page).decode("utf-8", "surrogatepass").split("\n") if x]
                gone = gone or bytes(len(found))
                texts.append(" ".join(t for (t, a), g in zip(found, gone) if not a and not g))
                counts.append(len(found))
                shared.append(sum(gone))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array(shared, pa.int64())], ["page_id", "url", "text", "n_chars", "n_lines", "n_shared"])

    return joined.select("page_id", "url", "packed", "gone").mapInArrow(run, f"{own}, text string, n_chars bigint, n_lines bigint, n_shared bigint")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op1_html": op1_html}
