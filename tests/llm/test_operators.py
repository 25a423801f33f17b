"""The corpus operators against brute force, and at the edges: nulls, empty and long texts, ties, repeats, no rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from py4j import clientserver
from pyspark.sql import functions as F

from sigframe.llm import op1_html, op2_lattice, op3_pii, op4_toxicity, op5_jaccard, op6_mixing, op7_bpe, op8_suffixes, op9_quality, op10_windows
from sigframe.llm.common import cut, tidy
from sigframe.llm.components import components, forest

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, node string, _sf_k string"


def documents(spark, rows, partitions=3):
    """Rows of (doc_id, text[, lang, source]), with further columns that carry the operators' own names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src", len(r[1] or ""), "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


def some_texts(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    sentence = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [sentence(rng.randint(52, 130)) for _ in range(4)]
    bases = [sentence(rng.randint(1, 150)) for _ in range(25)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            words = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randint(0, 1)] = sentence(rng.randint(0, 1))
        else:
            words = sentence(rng.randint(0, 60)) + rng.choice(passages) + sentence(rng.randint(0, 60))
        texts.append(rng.choice([" ", " ", "\n", "\t "]).join(words))
    return texts


EDGES = [(900, None), (901, ""), (902, "   \n\t "), (903, "word"), (903, "word"), (904, "two words"), (None, "one id is null"), (None, "one id is null"), (905, "é " * 3000), (906, "x" * 5000), (907, "a b c d e f g h i j " * 40)]


@pytest.fixture(scope="module")
def corpus():
    return list(enumerate(some_texts())) + EDGES


def key(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


# ---- 1 ----


def test_html(spark):
    page = lambda article, nav="Home", foot="(c) site": f"<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a>{nav}</a></nav><div class='ad'>Buy</div>{article}<footer>{foot}</footer></body></html>"
    plain = lambda body, menu="Menu": f"<body><div>{menu}</div><p>Shared line</p><p>{body}</p><p>Also shared</p></body>"
    rows = [
        (1, "http://a.org/x/1", page("<article><h1>T &amp; U</h1><p>One\n  two<br>three<p>f&#111;ur</article>")),
        (2, "http://a.org/x/2", page("<article><p>Other</p><div class=comments><p>reader</p></div></article>")),
        (3, "http://b.org/y/1", plain("first body")),
        (4, "http://b.org/y/2", plain("second body")),
        (5, "http://b.org/z", plain("third", "Menu 3")),
        (6, None, "<p>no url</p>"),
        (7, "http://a.org/x/3", None),
        (8, "junk", "plain text"),
        (9, "http://c.org/1", "<p>cut off <b"),
        (10, "http://c.org/1", "<p>cut off <b"),
        (11, "http://d.org/", ""),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, path string, lines string").repartition(4)
    got = {r.page_id: r for r in op1_html.extract(df).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert {i: got[i].text for i in (1, 2, 3, 4, 6, 7, 8, 9, 10, 11)} == {1: "T & U One two three four", 2: "Other", 3: "first body", 4: "second body", 6: "no url", 7: "", 8: "plain text", 9: "cut off", 10: "cut off", 11: ""}
    assert "third" in got[5].text and got[3].n_shared == 3
    assert op1_html.extract(df.where("false")).count() == 0


def test_html_lines_beside_the_article(spark):
    """Lines outside <article> and <main> stay unless a neighbour has them too; lines inside stay."""
    page = lambda lead, article, body: f"<body><div>Site line</div><p>{lead}</p><article><p>{article}</p><p>House style</p></article><div><p>{body}</p></div></body>"
    rows = [(1, "http://a.org/x/1", page("lead one", "article one", "body one")), (2, "http://a.org/x/2", page("lead two", "article two", "body two")), (3, "http://b.org/", page("lead", "article", "body"))]
    got = {r.page_id: r.text for r in op1_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "lead one article one House style body one", 2: "lead two article two House style body two", 3: "Site line lead article House style body"}


def test_html_repeated_pages(spark):
    """All copies of a page, also under other query strings, get the neighbour that one page would have."""
    plain = lambda body: f"<body><div>Menu</div><p>{body}</p><p>Also shared</p></body>"
    rows = [(i, f"http://a.org/x/1?q={i}", plain("first")) for i in range(5)] + [(10 + i, "http://a.org/x/2", plain("second")) for i in range(4)] + [(20, "http://b.org/x", plain("alone")), (21, "http://b.org/x", plain("alone"))]
    got = {r.page_id: r.text for r in op1_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == {i: "first" if i < 10 else "second" if i < 20 else "Menu alone Also shared" for i, _, _ in rows}


def test_html_containers_that_say_the_wrong_thing(spark):
    """A class word counts for nothing where the page's text is inside and no article stands outside."""
    wrong = ["<div class='layout no-sidebar'><p>Main text here</p></div>", "<article class='post social-enabled'><p>Main text here</p></article>", "<form id=all><p>Main text here</p><input></form>",
             "<div class='page with-menu'><article><p>Main text here</p></article><div class=comments><p>a reader's long comment of many words</p></div></div>"]
    assert [[t for t, a, _ in op1_html.lines(p) if not a] for p in wrong] == [["Main text here"]] * 4
    right = "<article><p>Main</p></article><section class=comments><article class=comment><p>a reader's long comment</p></article></section><form><p>search here for all that there is</p></form>"
    assert [t for t, a, _ in op1_html.lines(right) if not a] == ["Main"]


def test_html_differencing_decides(spark):
    """A generated site without telling markup, against the definition; without differencing the text is another."""
    rng = random.Random(11)
    sentence = lambda: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.randint(4, 12)))
    rows, bodies, copies = [], {}, {}
    for section in range(6):
        furniture = [sentence() for _ in range(4)]
        for number in range(9):
            body = [sentence() for _ in range(rng.randint(5, 30))]
            if number == 5:  # a copy of the page before, under an URL of its own, with a notice
                body = [sentence()] + copies[section]
            copies[section] = body
            i = len(rows)
            bodies[i] = body
            rows.append((i, f"http://site.org/s{section}/{number}?x={i}", "".join(f"<div>{t}</div>" for t in furniture[:2] + body + furniture[2:])))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in op1_html.extract(df).collect()}
    assert got == {i: " ".join(b) for i, b in bodies.items()}
    plain = {r.page_id: r.text for r in op1_html.extract(df, differencing=False).collect()}
    assert all(plain[i] != got[i] for i in got)


def test_html_brute_force(spark):
    """The pairs, and what goes, by the definition over whole hosts; more pages than a stretch."""
    rng = random.Random(12)
    rows = []
    for i in range(400):
        html = "".join(f"<p>{rng.choice('abcdefgh') * 3}</p>" for _ in range(rng.randint(0, 5)))
        rows.append((i, f"http://{rng.choice('aaab')}.org/{rng.choice('xyz')}/{rng.randint(0, 60)}", html))
    rows += [(1000 + i, f"http://a.org/{i}", "<p>aaa</p><p>same</p>") for i in range(50)]
    stretch, op1_html.STRETCH = op1_html.STRETCH, 16
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
        got = {r.page_id: r.text for r in op1_html.extract(df).collect()}
    finally:
        op1_html.STRETCH = stretch
    of = lambda url: (url.split("/")[2], "/" + url.split("/", 3)[3])
    pages = {}
    for _, url, html in rows:
        host, path = of(url)
        found = tuple(op1_html.numbered(op1_html.lines(html)))
        if found:
            pages[host, found] = min(path, pages.get((host, found), path))
    by_hash = lambda p: op1_html.xxhash.xxh3_64_intdigest(np.array(p, np.int64).tobytes()) - (1 << 63)
    order = sorted((host, path, by_hash(found), found) for (host, found), path in pages.items())
    at = {(host, found): i for i, (host, _, _, found) in enumerate(order)}
    for i, url, html in rows:
        found = op1_html.lines(html)
        gone = [False] * len(found)
        if found:
            host, place = of(url)[0], at[of(url)[0], tuple(op1_html.numbered(found))]
            near = [order[j] for d in (1, 2) for j in (place - d, place + d) if 0 <= j < len(order) and order[j][0] == host]
            gone = op1_html.judged(op1_html.numbered(found), order[place][1], [(n[1], n[3]) for n in near])
        assert got[i] == " ".join(t for (t, a, _), g in zip(found, gone) if not a and not g)


def test_html_very_long_page(spark):
    rows = [(1, "http://a.org/1", "<p>x</p>" * 30_000 + "<div>y " + "z " * 200_000 + "</div>" + "<div>" * 5000), (2, "http://a.org/2", "<p>x</p>" * 20_000 + "<p>w</p>")]
    got = {r.page_id: r for r in op1_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2].text == "w" and got[1].n_shared == 20_000 and got[1].text.endswith("y " + "z " * 199_999 + "z")


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 20))] for _ in range(2))
        for most in (1 << 20, 20):
            at = op1_html.common(a, b, most)
            rest = iter(b)
            assert len(at) == longest(a, b) and at == sorted(set(at)) and all(a[i] in rest for i in at)


# ---- 2 ----


def test_lattice(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        u, z = rng.standard_normal((2, 64))
        u /= np.linalg.norm(u)
        z -= u * (z @ u)
        c = 0.9802
        rows += [(2 * i, u.tolist(), 1), (2 * i + 1, (2 * (c * u + (1 - c * c) ** 0.5 * z / np.linalg.norm(z))).tolist(), 1 if i % 9 else 2)]
    b = rng.standard_normal(64)
    rows += [(1000 + i, (b + 0.06 * rng.standard_normal(64)).tolist(), 3) for i in range(90)] + [(2000 + i, b.tolist(), 3) for i in range(4)]
    rows += [(2003, b.tolist(), 3), (3000, [0.0] * 64, 3), (3001, None, 3), (3002, b.tolist(), None), (3003, [float("nan")] * 64, 3), (3004, [None] * 64, 3), (3005, [], 3), (3006, [1.0, 2.0], 3), (3007, [2.0, 4.0], 3), (3008, [float("inf")] + [0.0] * 63, 3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, cell int").repartition(3)
    got = op2_lattice.linked(df, chunk=40).collect()
    assert len(got) == len(rows)
    ids = [r[0] for r in rows]
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None else None for r in rows]
    linked = [[y for y in range(len(rows)) if y != x and unit[x] is not None and unit[y] is not None and rows[x][2] == rows[y][2] and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= 0.98] for x in range(len(rows))]
    component = {}
    for x in sorted(range(len(rows)), key=lambda i: ids[i]):
        stack = [x] if x not in component else []
        while stack:
            y = stack.pop()
            if y not in component:
                component[y] = ids[x]
                stack += linked[y]
    want = sorted((ids[x], len(linked[x]), component[x], component[x] == ids[x]) for x in range(len(rows)))
    right = sum(a == tuple(b) for a, b in zip(want, sorted(map(tuple, got))))
    links = sum(r.n_links for r in got)
    assert links <= sum(map(len, linked)) and links >= 0.99 * sum(map(len, linked)) and right >= 0.98 * len(rows)
    assert op2_lattice.linked(df.where("false")).count() == 0


@pytest.mark.parametrize("dimension", [2, 3, 8, 16, 64, 384, 1536])
def test_lattice_at_any_dimension(dimension):
    """Recall of planted pairs at the threshold, and how many random pairs meet."""
    rng = np.random.default_rng(dimension)
    n, space = 1500, np.zeros(1500, np.uint64)
    u, z = rng.standard_normal((2, n, dimension))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    z -= u * (z * u).sum(1, keepdims=True)
    v = 0.98 * u + (1 - 0.98**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = op2_lattice.cells(u, space), op2_lattice.cells(v, space)
    met = np.array([bool(np.intersect1d(x, y).size) for x, y in zip(a, b)])
    assert met.mean() >= 0.99
    if dimension >= 64:
        assert np.mean([bool(np.intersect1d(a[i], a[i + 1 + j]).size) for i in range(400) for j in range(25)]) < 0.01


# ---- 3 ----

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "card":
        doubled = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and doubled % 10 == 0
    return kind == "email" or kind == "ip" and all(int(x) <= 255 for x in value.split(".")) or kind == "phone" and 9 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, text) if holds(k, m.group())]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_personal_data(spark):
    pieces = ["a.b%c@d-e.f.g", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "00255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (555) 123-4567", "+49.30.1234567890123", "+1-", "é", "😀", "word", "\n", "123456789012345678901234567890", "4222222222222.", "1.1.1"]
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "", "\n"]).join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for i in range(250)] + EDGES + [(999, "a@b.de 1.2.3.4 " * 700), (998, "1 " * 60_000), (997, "a@b" + ".c" * 60_000), (996, "+1" + "-" * 60_000 + "2")]
    got = op3_pii.report(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((key(i), hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest(), *(sum(x.startswith(k + ":") for x in base_spans(t or "")) for k in KINDS)) for i, t in rows)
    assert sorted((key(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    for i, t in rows[:250]:
        told = [x for x in by_id[i].spans.split(",") if x and not x.startswith("term")]
        assert told == base_spans(t)
    clean = op3_pii.sanitise(documents(spark, rows))
    assert clean.columns == documents(spark, rows).columns and clean.count() == len(rows)
    for r in clean.collect():
        assert r.text is None or not re.search(KINDS["email"], r.text) and r.n_chars == len(r.text)
    assert op3_pii.report(documents(spark, rows).where("false")).count() == 0 and op3_pii.sanitise(documents(spark, rows).where("false")).count() == 0


def test_disclosing_terms(spark):
    rng = random.Random(9)
    filler = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "house", "tree"]) + rng.choice(["", "s", "ed"]) for _ in range(30))
    rows = [(i, f"{filler()} Zaphod writes from z@ship.org often {filler()}") for i in range(6)] + [(100 + i, filler()) for i in range(60)] + [(200, "z@ship.org alone"), (201, "once q@w.org Unique")]
    got = {r.doc_id: r for r in op3_pii.report(documents(spark, rows)).collect()}
    for i in range(6):
        words = [rows[i][1][int(a) : int(b)] for k, a, b in (x.split(":") for x in got[i].spans.split(",")) if k == "term"]
        assert "Zaphod" in words and not set(words) & {"alpha", "beta"}
    assert got[100].spans == "" and got[201].n_term == 0
    text = {r.doc_id: r.text for r in op3_pii.sanitise(documents(spark, rows)).collect()}
    assert "Zaphod" not in text[0] and "z@ship" not in text[0] and "[EMAIL]" in text[0] and text[100] == rows[6][1]


def told(spark, rows):
    """The words that op3_pii takes for terms, by doc_id."""
    texts = dict(rows)
    return {r.doc_id: {texts[r.doc_id][int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "term"} for r in op3_pii.report(documents(spark, rows)).collect()}


def test_terms_of_values_that_never_recur(spark):
    """A domain, a number's beginning, a kind: each value stands once."""
    plain = [(100 + i, f"plain words number{'abcdefghij'[i % 10]} of the house") for i in range(200)]
    got = told(spark, plain + [(i, f"the Zaphod a{i}@ship.org house") for i in range(4)] + [(10 + i, f"the Trillian +1 (555) 123-400{i} house") for i in range(4)] + [(20, "the house b@other.net")])
    assert all(got[i] == {"Zaphod"} and got[10 + i] == {"Trillian"} for i in range(4)) and not got[20] and not got[100]


def test_terms_of_the_whole_text(spark):
    """Terms count, and go, however far from the value; texts without it keep them."""
    far = "plain words of the house " * 40
    rows = [(i, f"Zaphod {far} z@ship.org {far} Zaphod {i}") for i in range(4)] + [(100 + i, far + str(i)) for i in range(200)]
    got = op3_pii.report(documents(spark, rows)).collect()
    assert all(r.n_term == (2 if r.doc_id < 100 else 0) for r in got)
    assert not any("Zaphod" in r.text for r in op3_pii.sanitise(documents(spark, rows)).collect())


def test_terms_of_texts_that_repeat(spark):
    """Copies of a text count once."""
    rows = [(i, f"the Zaphod z@ship.org house {'abcde'[i]}") for i in range(5)] + [(100 + i, f"the house {i}") for i in range(200)] + [(1000 + i, "the Zaphod z@ship.org house a") for i in range(300)]
    got = told(spark, rows)
    assert all(got[i] == {"Zaphod"} for i in (0, 1, 1000, 1299)) and not got[100]


def brute_terms(rows):
    """The words that disclose entities, by the definition over all distinct texts."""
    import math

    import regex

    found = {}
    for text in {t or "" for _, t in rows}:
        spans = [(m.start(), m.end(), k, m.group()) for k, p in KINDS.items() for m in re.finditer(p, text) if holds(k, m.group())]
        rest, entities = list(text), set()
        for s, e, k, v in spans:
            rest[s:e] = "0" * (e - s)
            digits = re.sub("[^0-9]", "", v)
            entities |= {(k, "kind"), (k, "value", v)}
            entities |= {(k, "same", v.lower()), (k, "part", v.lower().rsplit("@")[-1])} if k == "email" else set()
            entities |= {(k, "part", ".".join(v.split(".")[:2])), (k, "part", ".".join(v.split(".")[:3]))} if k == "ip" else set()
            entities |= {(k, "same", digits), (k, "part", digits[:6] if k == "card" else digits[:-7])} if k in ("card", "phone") else set()
        at = [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"(?<![\p{L}\p{N}])\p{L}{3,}(?![\p{L}\p{N}])", "".join(rest))]
        found[text] = entities, at
    n, n_e, n_t, n_te = len(found), {}, {}, {}
    for entities, at in found.values():
        terms = {w for _, _, w in at}
        for key, table in [((e,), n_e) for e in entities] + [((w,), n_t) for w in terms] + [((e, w), n_te) for e in entities for w in terms]:
            table[key] = table.get(key, 0) + 1
    told = {}
    for text, (entities, at) in found.items():
        flagged = {w for e in entities if 3 <= n_e[e,] < n for _, _, w in at if n_te[e, w] >= 3 and math.log(n * n_te[e, w] / (n_t[w,] * n_e[e,])) / math.log(n / n_e[e,]) >= 0.7}
        told[text] = [f"term:{a}:{b}" for a, b, w in at if w in flagged]
    return told


def test_terms_brute_force(spark):
    rng = random.Random(17)
    common = [f"common{c}" for c in "abcdefgh"]
    special = [["Zaphod", "betel"], ["Marvin", "androïd"], ["Trillian"]]
    values = [lambda: f"a{rng.randint(0, 99)}@ship.org", lambda: f"10.0.{rng.randint(0, 3)}.{rng.randint(0, 255)}", lambda: f"+1 (555) 123-40{rng.randint(10, 99)}"]
    rows = []
    for i in range(260):
        words = [rng.choice(common) for _ in range(rng.randint(2, 12))]
        if rng.random() < 0.4:
            kind = rng.randrange(3)
            words += [values[kind](), rng.choice(special[kind]) if rng.random() < 0.8 else "plain"]
        if rng.random() < 0.06:
            words.append(rng.choice(special[rng.randrange(3)]))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += rows[:40]
    want = brute_terms(rows)
    got = op3_pii.report(documents(spark, rows)).collect()
    texts = dict(rows)
    assert sum(map(len, want.values())) > 50
    assert all(sorted(x for x in r.spans.split(",") if x.startswith("term")) == sorted(want[texts[r.doc_id]]) for r in got)


# ---- 4 ----


def test_toxicity(spark):
    rng = random.Random(5)
    mild = ["the", "and", "river", "stone", "green", "walks", "into", "town"]
    bad = ["grumbold", "snarkface"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rng.choice(mild) for _ in range(rng.randint(5, 60))]
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += EDGES + [(1000, "you GRUМB0LD you 5n4rkface"), (1001, "river trash can")]
    docs, marked = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = op4_toxicity.learn(docs, marked)
    got = op4_toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    predicted = {r.doc_id: r.predicted for r in got}
    assert all(predicted[i] == t for i, _, t in labels) and predicted[1000] == 1 and predicted[1001] == 0 and predicted[900] == 0
    kept = op4_toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert op4_toxicity.learn(docs, marked.where("false")).weights == {} and op4_toxicity.scored(docs.where("false"), model).count() == 0


def test_folding_and_exceptions():
    assert op4_toxicity.fold("Ídі0т Ｗord​") == "idiot word"
    assert op4_toxicity.fold("stupid!! a$$hat w|se 5tup1d") == "stupid  asshat wlse stupid"
    model = op4_toxicity.Lexicon({"trash": 5.0}, 1.0, -2.0)
    machine = model.automaton()
    assert op4_toxicity.raw_score("trash can", machine)[1] == 0 and op4_toxicity.raw_score("a trash can of trash", machine)[1] == 1


def naive_score(text, model):
    """The raw score word by word."""
    words = op4_toxicity.fold(text).split()
    excused = set()
    for phrase in model.exceptions:
        p = op4_toxicity.fold(phrase).split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                excused |= set(range(i, i + len(p)))
    total = 0.0
    for i, w in enumerate(words):
        own = [model.weights[w]] if w in model.weights else [model.weights[w[: -len(e)]] for e in ("s", "es") if w.endswith(e) and w[: -len(e)] in model.weights][-1:]
        stems = [v for k, v in model.weights.items() if k.endswith("-") and w.startswith(k[:-1])]
        total += 0 if i in excused else own[0] if own else max(stems, default=0)
    return total / np.log2(8 + len(words)) if words else 0.0


def test_toxicity_naive_matcher():
    rng = random.Random(21)
    entries = ["idiot", "trash", "trashes", "scum", "glas", "reeux-", "reeuxe-", "tra-", "bo-"]
    model = op4_toxicity.Lexicon({e: rng.uniform(1, 6) for e in entries}, 1.0, -2.0, op4_toxicity.EXCEPTIONS + ("one idiot", "idiot of"))
    machine = model.automaton()
    words = ["idiot", "1D10T!", "idiots", "idiotic", "trash", "trashes", "trasheses", "can", "scum", "pond", "glas", "glass", "glasses", "réeuxelle", "reeux", "reeu", "trace", "bo", "b", "one", "of", "the", "$cum", "scum$", ""]
    for _ in range(600):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        assert np.isclose(op4_toxicity.raw_score(text, machine)[0], naive_score(text, model)), text


def test_toxicity_words_that_begin_others(spark):
    """Harmless words that begin as an insult does; insults that are harmless in a phrase; near copies count once."""
    rng = random.Random(22)
    mild = "the and river stone green walks into town reading house tree paper water light music table".split()
    bad = ["worthless", "moron", "idiot", "pathetic", "trash"]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 5 == 0
        words = [rng.choice(mild) for _ in range(rng.randint(8, 60))]
        words.insert(3, rng.choice(bad) if toxic else rng.choice(["trash dumpster", *mild * 2]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(2000 + i, "one copied text that is toxic by its label and holds rareword " + "and more of it " * 30 + str(i)) for i in range(40)]
    labels += [(2000 + i, 1, 1) for i in range(40)]
    model = op4_toxicity.learn(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(model.weights) >= set(bad) and not any(w.startswith("rare") for w in model.weights) and any("trash dumpster" in p for p in model.exceptions)
    machine = model.automaton()
    score = lambda t: model.score(op4_toxicity.raw_score(t, machine)[0])
    assert all(score(t) < 0.3 for t in ["It is worth reading.", "Morocco exported phosphate", "This idiom is old", "Follow the file path", "a trash dumpster", "the trash can"])
    assert all(score(t) >= 0.3 for t in ["You worthless thing", "m0r0n!", "what idiots", "PATHETIC", "trash"])


# ---- 5 ----


def brute_join(rows, words, num, den):
    table = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, t in rows:
        w = re.findall(WORD, (t or "").translate(table))
        sets.append({tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    first = list(range(len(rows)))

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            both = len(a & sets[y])
            if both and den * both >= num * (len(a) + len(sets[y]) - both):
                first[max(find(x), find(y))] = min(find(x), find(y))
    least = {}
    for x in range(len(rows)):
        least[find(x)] = min(least.get(find(x), 1 << 62), key(rows[x][0]))
    return [(key(rows[x][0]), len(sets[x]), least[find(x)]) for x in range(len(rows))]


@pytest.mark.parametrize("words,num,den", [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_jaccard(spark, corpus, words, num, den):
    got = op5_jaccard.join(documents(spark, corpus), words, num, den).collect()
    assert sorted((r.k, r.n_shingles, r["first"]) for r in got) == sorted(brute_join(corpus, words, num, den))


def test_distinct_documents(spark, corpus):
    docs = documents(spark, corpus)
    kept = op5_jaccard.distinct_documents(docs)
    want = brute_join(corpus, 5, 4, 5)
    groups = {c for _, n, c in want if n}
    empty = sum(n == 0 for _, n, _ in want)
    assert kept.columns == docs.columns and kept.count() == len(groups) + empty
    assert {key(r.doc_id) for r in kept.collect()} == groups | {i for i, n, _ in want if not n}
    assert op5_jaccard.distinct_documents(docs.where("false")).count() == 0


def held_texts(rng, passages, docs):
    """Documents (passages held, number of own words) as rows; passages are given by number of words."""
    made = [[f"p{i}x{x}" for x in rng.integers(0, 1 << 30, n)] for i, n in enumerate(passages)]
    return [(i, " ".join([w for p in held for w in made[p]] + [f"u{x}" for x in rng.integers(0, 1 << 30, own)])) for i, (held, own) in enumerate(docs)]


def test_what_many_documents_hold_chains_no_clusters(spark):
    """All documents hold one passage, and two by two a further one: one cluster of all would be sent part by part."""
    rows = held_texts(np.random.default_rng(1), [80] + [200] * 20, [((0, 1 + i // 2), 40) for i in range(40)])
    docs = documents(spark, rows)
    edges = op5_jaccard.candidates(docs, op5_jaccard.sets_of(docs, 5), 5, 4, 5).toPandas()
    root, _ = forest(edges["a"].to_numpy(), edges["b"].to_numpy())
    assert len(root) >= 20 and np.unique(root, return_counts=True)[1].max() < 10


def test_a_large_cluster_is_sent_in_rounds(spark, monkeypatch):
    """However many parts a cluster has, a text goes twice at most through one shuffle, and all parts meet."""
    rows = held_texts(np.random.default_rng(2), [100] * 3, [((0, 1 + i % 2), 1 + i % 9) for i in range(60)])
    docs, sent = documents(spark, rows), []
    monkeypatch.setattr(op5_jaccard, "CHUNK", 3000)  # each 30 texts of 200 tokens have 4 parts
    monkeypatch.setattr(type(docs), "repartition", lambda df, *a, f=type(docs).repartition: (sent.append(df.count()) if "i" in df.columns else None) or f(df, *a))
    got = op5_jaccard.join(docs, 5, 4, 5).collect()
    assert sorted((r.k, r.n_shingles, r["first"]) for r in got) == sorted(brute_join(rows, 5, 4, 5))
    assert len(sent) > 1 and max(sent) <= 2 * len(rows)


def test_tidy_lets_shuffle_files_go(spark, monkeypatch):
    """What was dropped just before goes by the same call, also where the JVM is late to hear of it."""
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    shuffles = lambda: set(tracker.shuffleStatuses().keySet().mkString(" ").split())
    counted = lambda: cut(spark.range(1000).groupBy((F.col("id") % 7).alias("m")).count())
    assert counted().count() == 7
    monkeypatch.setattr(clientserver, "DEFAULT_WORKER_SLEEP_TIME", 6)
    time.sleep(1.5)
    before = shuffles()
    kept = counted()
    made = shuffles() - before
    tidy(spark)
    time.sleep(0.7)
    assert made and not made & shuffles()
    assert kept.count() == 7


def test_rtree_finds_all():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, rng.integers(5, 120)).astype(np.uint64)
        for _ in range(rng.integers(1, 8)):
            own = base.copy()
            own[rng.random(len(own)) < 0.04] = rng.integers(0, 1 << 62)
            sets.append(np.unique(own))
    got = op5_jaccard.links(sets, 9, 10)
    a, b = forest(*np.array(got).T)
    want = [(x, y) for x in range(len(sets)) for y in range(x) if 10 * len(o := np.intersect1d(sets[x], sets[y])) >= 9 * (len(sets[x]) + len(sets[y]) - len(o))]
    c, d = forest(*np.array(want).T)
    assert set(zip(a, b)) == set(zip(c, d))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(-5, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    a, b = forest(*np.array([e for e in edges if e[0] != e[1]]).T)
    want = dict(zip(b.tolist(), a.tolist()))
    assert got == {n: want.get(n, n) for e in edges if e[0] != e[1] for n in e}


def test_components_of_few_edges_take_few_tasks(spark):
    """What the driver keeps of tasks grows with the shuffles of all partitions; edges that fit one task need none."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(80)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    was, sc = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    sc.setJobGroup("few edges", "")
    try:
        got = {r.id: r.component for r in components(df).collect()}
        seen = sc.statusTracker()
        stages = {s for j in seen.getJobIdsForGroup("few edges") for s in seen.getJobInfo(j).stageIds}
        tasks = sum(info.numTasks for s in stages if (info := seen.getStageInfo(s)))
        assert tasks < 60
        assert got == {r.id: r.component for r in components(df, few=10).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert components(df.limit(0)).count() == 0


# ---- 6 ----


def test_mixing(spark, corpus):
    rng = random.Random(1)
    sources = ["b", "a", "c", None, "d", "é"]
    rows = [(i, t, "en", rng.choice(sources)) for i, t in corpus]
    got = op6_mixing.mix(documents(spark, rows), shard_words=2000, block=16).collect()
    assert len(got) == len(rows)
    sizes = {s: sum(len(re.findall(WORD, t or "")) for _, t, _, x in rows if x == s) for s in sources}
    order = sorted((s for s in sources if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full, left = {}, set(), sum(sizes.values())
    while True:
        over = [s for s in sources if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in over) for s in over}
        stop = [s for s in over if share[s] > 3 * sizes[s]]
        if not stop:
            break
        for s in stop:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
            full.add(s)
    target |= share
    for s in sources:
        mine = [r for r in got if r.src == s]
        assert all(np.isclose(r.target, target[s]) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 16 * (sizes[s] // 2000 + 2) and all(r.taken <= 3 * r.size for r in mine)
    again = op6_mixing.mix(documents(spark, rows, 7), shard_words=2000, block=16).collect()
    assert sorted((key(r.doc_id), r.size, r.taken) for r in got) == sorted((key(r.doc_id), r.size, r.taken) for r in again)
    out = op6_mixing.sampled(documents(spark, rows), shard_words=2000, block=16)
    assert out.columns == documents(spark, rows).columns
    words = lambda rows: sum(len(re.findall(WORD, r.text)) for r in rows)
    assert words(out.collect()) == sum(r.taken for r in got)
    assert op6_mixing.mix(documents(spark, rows).where("false")).count() == 0


def brute_seats(votes, house, caps):
    """By the definition: one seat after the other to the highest quotient."""
    seats = [0] * len(votes)
    for _ in range(house):
        able = [i for i in range(len(votes)) if seats[i] < caps[i] and votes[i] > 0]
        if not able:
            break
        seats[max(able, key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))] += 1
    return seats


def test_sainte_lague(spark):
    rng = random.Random(13)
    rows, want = [], {}
    for g in range(60):
        n = rng.choice([1, 2, 3, 7, 30])
        votes = [rng.choice([0, 1, 5, rng.randint(1, 50), rng.randint(1, 5000)]) for _ in range(n)]
        house = rng.choice([0, 1, n, 10 * n, rng.randint(1, 400)])
        caps = [rng.choice([1 << 40, 1 << 40, rng.randint(1, house // n + 2)]) for _ in range(n)]
        rows += [(g, i, v, house, c) for i, (v, c) in enumerate(zip(votes, caps))]
        want |= {(g, i): s for i, s in enumerate(brute_seats(votes, house, caps))}
    df = spark.createDataFrame(rows, "g int, i int, votes long, house long, cap long").repartition(3)
    got = {(r.g, r.i): r.seats for r in op6_mixing.apportioned(df, ["g"], "votes", "house", "cap", ["i"]).collect()}
    assert got == want


def test_mixing_without_ids(spark):
    """Rows without an id, or with one id, are dealt to shards by their texts; reruns agree on whole rows."""
    rows = [(None if i % 2 else 7, f"text number {i} " * 20, "en", "s") for i in range(300)]
    got = op6_mixing.mix(documents(spark, rows), shard_words=500, block=16).collect()
    assert len({r.shard for r in got}) > 30
    runs = [sorted(r.text for r in op6_mixing.sampled(documents(spark, rows, n), shard_words=500, block=16).collect()) for n in (3, 5)]
    assert runs[0] == runs[1]
    assert op6_mixing.sampled(documents(spark, rows).where("false")).count() == 0


# ---- 7 ----


def test_bpe(spark, corpus):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(op7_bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op7_bpe.load(path), special_tokens={})
    rows = corpus + [(950, "naïve 😀 日本語 ÿ́ don't 12345   \n\n end"), (951, "<|endoftext|> thattheand" * 20)]
    got = op7_bpe.tokenize(documents(spark, rows), path, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((key(i), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    small = op7_bpe.Codec(op7_bpe.load(path), public_tokenizers.PATTERN)
    small.transducer.most_states = 5  # forgets within a piece
    assert all(small.encode(t or "") == library.encode_ordinary(t or "") for _, t in rows[:30] + rows[-2:])


def test_streaming_decode():
    text = "aé日😀z".encode()
    for size in (1, 2, 3, 5):
        machine = op7_bpe.Utf8()
        assert "".join(machine.feed(text[i : i + size]) for i in range(0, len(text), size)) + machine.finish() == text.decode()
    for broken in (b"\xff\xfea", b"\xe6\x97", b"\xf0\x9f\x98", b"\xc0\x80", b"a\x80\x80\x80\x80b"):
        machine = op7_bpe.Utf8()
        assert "".join(machine.feed(bytes([c])) for c in broken) + machine.finish() == broken.decode("utf-8", "replace")


# ---- 8 and 10 ----


def distinct_rows(rows):
    return [r for i, r in enumerate(rows) if r not in rows[:i]]


def brute_bytes(rows):
    seen, out = set(), {}
    for i, t in sorted(distinct_rows(rows), key=lambda r: key(r[0])):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for j in range(len(data) - 99):
            s = data[j : j + 100]
            if s in seen:
                gone[j : j + 100] = True
            seen.add(s)
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[i, t] = (len(data), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest())
    return sorted((key(i), *out[i, t]) for i, t in rows)


def brute_words(rows):
    first = {}
    words = [re.findall(WORD, t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for j in range(len(w) - 49):
            s = tuple(w[j : j + 50])
            first[s] = min(first.get(s, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < key(i):
                gone[j : j + 50] = True
        out.append((key(i), len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def test_repeated_bytes(spark, corpus):
    got = op8_suffixes.deduplicated(documents(spark, corpus)).collect()
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(corpus)
    assert op8_suffixes.deduplicated(documents(spark, corpus).where("false")).count() == 0


def test_repeated_words(spark, corpus):
    got = op10_windows.deduplicated(documents(spark, corpus)).collect()
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == brute_words(corpus)
    assert op10_windows.deduplicated(documents(spark, corpus).where("false")).count() == 0


def test_many_surroundings(spark):
    """One passage in many documents: more surroundings than are sorted together."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    passage = [word() for _ in range(70)]
    rows = [(i, " ".join([word() for _ in range(rng.randint(0, 9))] + passage[rng.randint(0, 3) : 70 - rng.randint(0, 3)] + [word() for _ in range(rng.randint(0, 9))])) for i in range(420)]
    got = op8_suffixes.deduplicated(documents(spark, rows, 6)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows)
    got = op10_windows.deduplicated(documents(spark, rows, 6)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == brute_words(rows)


def test_many_surroundings_in_some_batches(spark):
    """Passages in 20 surroundings each, copied many times: few of them in batches of early ids, all in others."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    texts = []
    for _ in range(8):
        passage = [word() for _ in range(26)]
        texts.append([" ".join([word() for _ in range(8)] + passage + [word() for _ in range(8)]) for _ in range(20)])
    parts = [[v for _ in range(3) for v in range(15)], [v for _ in range(5) for v in range(20)], [v for v in range(5, 10)] * 4]
    rows, tasks = [], []
    for part in parts:
        some = [(len(rows) + i, variants[v]) for i, (v, variants) in enumerate((v, t) for v in part for t in texts)]
        rows += some
        tasks.append(spark.sparkContext.parallelize(some, 1))  # a union of frames would be one task
    df = spark.createDataFrame(spark.sparkContext.union(tasks), "doc_id long, text string")
    got = op8_suffixes.deduplicated(df).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows)


def test_deep_shallow():
    rng = random.Random(2)
    for _ in range(60):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        strings = []
        for _ in range(rng.randint(1, 40)):
            s = bytearray(base[: rng.randint(0, 60)])
            for _ in range(rng.randint(0, 2)):
                if s:
                    s[rng.randrange(len(s))] = rng.choice(b"abc")
            strings.append(bytes(s))
        rows, lengths = np.zeros((len(strings), 64), np.uint8), np.array([len(s) for s in strings])
        for row, s in zip(rows, strings):
            row[: len(s)] = np.frombuffer(s, np.uint8)
        group = np.array([rng.randint(0, 2) for _ in strings], np.uint64)
        order = op8_suffixes.deep_shallow(group, rows, lengths)
        assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings))


def test_the_order_decides(monkeypatch, spark):
    """Without the order's common prefixes nothing repeats; in an order that is none, less does."""
    rng = random.Random(31)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) + "the passage that all of them hold, " * 4 + str(i % 7) * 40) for i in range(40)]
    docs = documents(spark, rows, 1)
    want = sum(r[2] for r in brute_bytes(rows))
    assert sum(r.n_removed for r in op8_suffixes.deduplicated(docs).collect()) == want > 0
    texts = [t.encode() for _, t in rows]
    at = [t.index(b"the passage") for t in texts]
    around = np.zeros((len(rows), op8_suffixes.AROUND), np.uint8)
    left, right = np.minimum(at, op8_suffixes.BACK), np.array([min(len(t) - a, op8_suffixes.WINDOW) for t, a in zip(texts, at)])
    for row, t, a, n, m in zip(around, texts, at, left, right):
        row[op8_suffixes.BACK - n : op8_suffixes.BACK + m] = np.frombuffer(t[a - n : a + m], np.uint8)
    given = (np.zeros(len(rows), np.uint64), around, left.astype(np.int64), right.astype(np.int64), np.arange(len(rows)))
    found = {(b, int(i)) for b, out in op8_suffixes.repeats_around(*given) for i in out}
    brute = {(b, i) for b in range(op8_suffixes.BACK + 1) for i in range(len(rows)) if left[i] >= b and right[i] >= op8_suffixes.WINDOW - b
             and any(left[j] >= b and right[j] >= op8_suffixes.WINDOW - b and texts[i][at[i] - b :][:100] == texts[j][at[j] - b :][:100] for j in range(i))}
    assert found == brute and any(b for b, _ in brute)
    monkeypatch.setattr(op8_suffixes, "deep_shallow", lambda group, rows, lengths, start=0: np.random.default_rng(1).permutation(len(group)))
    assert {(b, int(i)) for b, out in op8_suffixes.repeats_around(*given) for i in out} < brute


def test_the_tree_decides(monkeypatch):
    """All pairs that are counted come from the tree, which leaves most of the others out."""
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 1 << 62, 150).astype(np.uint64) for _ in range(30)]
    sets = [np.unique(np.concatenate((b[i:], rng.integers(0, 1 << 62, i).astype(np.uint64)))) for b in base for i in range(4)]
    counted = []
    monkeypatch.setattr(op5_jaccard, "overlap", lambda a, b, f=op5_jaccard.overlap: counted.append(1) or f(a, b))
    assert len(op5_jaccard.links(sets, 9, 10)) == 90 and len(counted) < 0.05 * len(sets) * (len(sets) - 1) / 2
    monkeypatch.setattr(op5_jaccard.RTree, "pairs", lambda self, *a: iter(()))
    assert op5_jaccard.links(sets, 9, 10) == [] and op5_jaccard.links(sets[:2], 9, 10) == []


# ---- 9 ----


def test_quality(spark, corpus):
    rows = corpus + [(960, "a b c d e f g h\nx\nx\n\n \nx y"), (961, "# * | <a> & $$ %"), (962, "the cat of a hat " * 20), (963, "THE!! ### $$$ %%% &&& ||| " * 20, "en"), (964, "the cat", None), (965, "der die und", "xx")]
    got = op9_quality.judge(documents(spark, rows)).collect()
    want = []
    for r in rows:
        text = r[1] or ""
        w = re.findall(WORD, text)
        full = [x for x in text.split("\n") if re.search(WORD, x)]
        at = {}
        for j in range(len(w) - 7):
            at.setdefault(tuple(w[j : j + 8]), []).append(j)
        covered = {j + i for js in at.values() if len(js) > 1 for j in js for i in range(8)}
        bad = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.append((key(r[0]), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered), bad))
    assert sorted((key(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert all(not (r.base_failed and r.kept) for r in got)
    assert op9_quality.judge(documents(spark, rows).where("false")).count() == 0


def test_divergence(spark):
    rng = random.Random(7)
    plain = [(i, " ".join(rng.choice("the of and to in a is cat house tree river stone road".split()) for _ in range(120)).capitalize() + ".") for i in range(60)]
    junk = [(100, " | ".join(rng.choice(["xq", "zv", "kk"]) for _ in range(120))), (101, "XQ!! ZV** " * 3)]
    got = {r.doc_id: r for r in op9_quality.judge(documents(spark, plain + junk)).collect()}
    assert all(got[i].kept for i in range(60)) and not got[100].kept and got[100].js_words > 0.4
    near, far = (np.array(got[i].chars) / sum(got[i].chars) for i in (0, 100))
    assert near.shape == far.shape


# ---- packed records ----


@pytest.mark.parametrize("n", [0, 5, 3000])
def test_sections(n):
    """All records come back, each section whole, whether a row holds one section or several."""
    from sigframe.llm import common

    rng = np.random.default_rng(n)
    key, value = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(-9, 9, n)
    rows = [common.blocks(key[i::3], (key[i::3], value[i::3]), 4, 7) for i in range(3)] + [common.blocks(key[:7], (key[:7], value[:7]), 4, 7)]
    by_part = {}
    for batch in rows:
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
            by_part.setdefault(bucket // (common.FINE + 1), []).append((bucket, block))
    import pyarrow as pa

    seen, told = set(), []
    for part in by_part.values():
        part.sort(key=lambda x: x[0])
        for held in common.sections([pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.int32()), pa.array([x for _, x in part], pa.binary())], ["bucket", "block"])]):
            assert all(memoryview(x)[0] == 7 for x in held)
            k, v = common.unpack(held, ("<u8", "<i8"), 1)
            places = set((k % np.uint64(4 * common.FINE)).tolist())
            assert len(places) == 1 and not places & seen
            seen |= places
            told += zip(k.tolist(), v.tolist())
    assert sorted(told) == sorted([*zip(key.tolist(), value.tolist()), *zip(key[:7].tolist(), value[:7].tolist())])


def test_workers_make_room():
    """What the tokens' tasks keep in a worker goes when it turns to other work."""
    import public_tokenizers

    from sigframe.llm import common

    given = public_tokenizers.path(op7_bpe.VOCABULARY), public_tokenizers.PATTERN
    kept = op7_bpe.codec(*given)
    assert op7_bpe.codec(*given) is kept
    assert list(common.texts_in(iter([]))) == []
    assert op7_bpe.codec(*given) is not kept
