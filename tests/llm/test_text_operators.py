"""Mixing, personal data, chats, pages, decontamination, quality and languages."""

import hashlib
import itertools
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import chat, decontam, html_extract, langid, mixing, pii, quality

from .conftest import DOCS, words

# ------------------------------------------------------------------ mixing


@pytest.fixture
def mixed(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(0, 60)), "en", rng.choice(["big"] * 12 + ["a", "b", "c", None]), 0) for i in range(400)] + [(1000, None, "en", "empty", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_mix_reaches_targets(mixed):
    got = mixing.mix_sources(mixed).toPandas().merge(mixed.select("doc_id", "source").toPandas(), on="doc_id")
    assert len(got) == 401 and (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()
    for _, g in got.groupby(got["source"].fillna("~")):
        assert g["taken"].sum() == int(np.floor(g["target"].iloc[0])) and g["size"].sum() == g["source_size"].iloc[0]
        assert g["target"].iloc[0] <= 3 * g["source_size"].iloc[0] + 1e-9
    per = got.drop_duplicates("source")
    assert abs(per["target"].sum() - got["size"].sum()) < 1e-6
    again = mixing.mix_sources(mixed.repartition(7)).toPandas().set_index("doc_id")["taken"]
    assert again.sort_index().equals(got.set_index("doc_id")["taken"].sort_index())


def test_mix_matches_sql(mixed):
    docs = mixed.toPandas()  # noqa: F841  read by the query
    want = duckdb.sql(mixing.ORACLE.replace("{docs}", "docs")).df().sort_values("doc_id").reset_index(drop=True)
    got = mixing.mix_sources(mixed).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert np.array_equal(got["taken"], want["taken"]) and np.allclose(got["target"], want["target"])


def test_mix_of_hot_ids(spark):
    """Rows without an id, and repeats of one row, are split between buckets and taken as SQL takes them."""
    rows = [(None, "w " * (i % 9), "a") for i in range(900)] + [(7, "x y z", "a")] * 700 + [(i, "w " * (i % 5), None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    table = docs.toPandas().astype({"doc_id": "Int64"})  # noqa: F841  read by the query
    want = duckdb.sql(mixing.ORACLE.replace("{docs}", '"table"'))
    got = mixing.mix_sources(docs).select(*want.columns).collect()
    plain = lambda found: sorted(str(tuple(r)) for r in found)
    assert plain(got) == plain(want.fetchall())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        slim = docs.selectExpr("doc_id as id", "source", "1L as size", "'k' as key", "monotonically_increasing_id() as place")
        spread = mixing.in_buckets(slim).groupBy("id").agg(F.countDistinct("bucket").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["id"]: r["n"] for r in spread}[None] > 1


def test_mix_odd_rows(docs_of, odd_rows):
    assert mixing.mix_sources(docs_of(odd_rows)).count() == len(odd_rows)
    assert mixing.mix_sources(docs_of([(1, "a")]).where("false")).collect() == []
    assert mixing.mix_sources(docs_of([(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


# ----------------------------------------------------------- personal data


def brute_spans(t):
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for k, pattern, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 13, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if lo <= len(d) <= hi and (k == 3 or luhn(d)):
                out.append((k, *m.span()))
    return out


def test_base_spans_match_regexes():
    rng = random.Random(6)
    pieces = ["a.b", "@", "x-y.com", "mail", ".", "..", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", " ", "-", "(", ")", "é", "0", "00", "7" * 13, "\n", ","]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert sorted(pii.base_spans(t)) == sorted(brute_spans(t)), t


def test_long_runs_stay_fast():
    for t in ("a" * 200_000, "1" * 200_000, "a" * 100_000 + "@", "+" + "1 " * 50_000, "1." * 100_000, "a@" * 50_000):
        pii.base_spans(t)


def test_skip_chain_adds_equal_tokens(docs_of):
    rng = random.Random(8)
    card = "4111111111111111"
    train = [(i, f"{words(rng, 20)} {card} {words(rng, 5)} 10.0.0.{i} end{i}") for i in range(60)]
    field = pii.fit([t for _, t in train])
    text = f"first {card} then 1234567812345678 {card} again"
    base, added = pii.find_spans(text, field)
    assert [(k, text[s:e]) for k, s, e in base] == [(2, card)]
    assert (2, card) in [(k, text[s:e]) for k, s, e in added]
    assert pii.find_spans("In 2020 there were 17 of 20 items left", field) == ([], [])


def test_labels_reach_all_occurrences():
    n, k = 60, len(pii.LABELS)
    rng = np.random.default_rng(2)
    x = np.zeros((n, 1 + k))
    x[:, 0] = 1
    x[0, 3] = 12.0
    field = pii.Field(np.vstack([[0.1] + [0] * (k - 1), np.eye(k)]), rng.normal(size=(k, k)), np.eye(k) * 6 - 3)
    skip = np.array([(i - 1, i) for i in range(1, n)])
    p = field.marginals(x, np.zeros((0, 2), np.int64), skip)
    # exact sums along the chain from both ends
    unary, pair = np.exp(x @ field.unary), np.exp(field.skip)
    up, down = np.ones((n, k)), np.ones((n, k))
    for i in range(1, n):
        up[i] = (up[i - 1] * unary[i - 1]) @ pair
        up[i] /= up[i].sum()
        j = n - 1 - i
        down[j] = pair @ (down[j + 1] * unary[j + 1])
        down[j] /= down[j].sum()
    want = up * down * unary
    assert np.allclose(p, want / want.sum(1, keepdims=True), atol=1e-4) and p[30, 2] > 1.05 * p[30, 1]
    loops = field.marginals(rng.normal(size=(n, 1 + k)), skip, np.array([(i, j) for i in range(0, n, 3) for j in range(i + 3, n, 9)]))
    assert np.allclose(loops.sum(1), 1)
    assert pii.edges("a@b.c 1 a@b.c", pii.candidates("a@b.c 1 a@b.c"))[1].tolist() == [[0, 2]]


def test_marginals_match_enumeration():
    """All labellings of small graphs, summed; exact without circles, close with one."""
    rng = np.random.default_rng(5)
    k = len(pii.LABELS)
    for n, chain, skip, near in ((4, [(0, 1), (1, 2)], [(0, 3)], 1e-5), (4, [], [(0, 1), (0, 2), (0, 3)], 1e-5), (4, [(0, 1), (1, 2), (2, 3)], [(0, 3)], 0.05)):
        x = rng.normal(size=(n, pii.N_FEATURES))
        field = pii.Field(rng.normal(size=(pii.N_FEATURES, k)) * 0.3, rng.normal(size=(k, k)) * 0.5, np.eye(k) + rng.normal(size=(1, 1)))
        labels = np.array(list(itertools.product(range(k), repeat=n)))
        score = sum((x[i] @ field.unary)[labels[:, i]] for i in range(n)) + sum(t[labels[:, i], labels[:, j]] for t, e in ((field.chain, chain), (field.skip, skip)) for i, j in e)
        weight = np.exp(score - score.max())
        want = np.array([np.bincount(labels[:, i], weight, k) for i in range(n)]) / weight.sum()
        got = field.marginals(x, np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2))
        assert np.abs(got - want).max() < near


def personal(rng):
    """A base span of each kind, another writing of it that no pattern finds, and a number that only looks like that."""
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    area, line = digits(3), f"555{digits(4)}"
    phone, other = f"+1 ({area}) {line[:3]}-{line[3:]}", digits(10)
    name = "".join(rng.choice("abcdefgh") for _ in range(8))
    ip, ip2 = (".".join(str(rng.randrange(11, 250)) for _ in range(4)) for _ in range(2))
    key, key2 = ("".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(2))
    card = next(c for c in (digits(16) for _ in range(500)) if pii.luhn(c))
    dots = lambda c: ".".join(c[k : k + 4] for k in range(0, 16, 4))
    return [("phone", phone, area + line, other), ("email", f"{name}.{digits(2)}@mail.example.com", None, f"{name[::-1]}@{digits(2)}"), ("ip", ip, ip.replace(".", "[.]"), ip2.replace(".", "[.]")), ("card", card, dots(card), dots(digits(16))), ("secret", f'token = "{key}"', key, key2)]


def test_field_finds_other_writings():
    """Trained on base spans alone, it adds the other writings of what a document holds and leaves look-alikes."""
    rng = random.Random(12)

    def page(rows):
        parts = [words(rng, 12)]
        for kind, seen, again, decoy in rows:
            again = again or seen.partition("@")[0] + "@mail"
            order = [seen, again] if rng.random() < 0.7 else [again, seen]
            parts += [order[0], words(rng, rng.randrange(3, 30)), order[1], words(rng, 8), decoy, words(rng, 9)]
        return " ".join(parts)

    train = []
    for _ in range(150):
        train.append(" ".join(f"{words(rng, 9)} {seen}" for _, seen, *_ in rng.sample(personal(rng), 3)) + f" in {rng.randrange(1990, 2024)} {rng.randrange(10**15, 10**16)}1 end")
    field = pii.fit(train)
    want = found = right = 0
    for _ in range(60):
        rows = personal(rng)
        text = page(rows)
        base, added = pii.find_spans(text, field)
        assert base == sorted(brute_spans(text))
        got = {(pii.ALL_KINDS[k], text[s:e]) for k, s, e in added}
        expected = {(kind, again or seen.partition("@")[0] + "@mail") for kind, seen, again, _ in rows}
        want, found, right = want + len(expected), found + len(got), right + len(got & expected)
    assert right / want > 0.9 and right / found > 0.95, (right, want, found)


@pytest.mark.parametrize("copies", [1, 2, 5, 80, 500])
def test_field_reaches_all_copies(copies):
    rng = random.Random(copies)
    field = pii.fit([f"{words(rng, 9)} +49 30 {rng.randrange(10**6, 10**7)} {words(rng, 5)} +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} in 2019" for _ in range(50)])
    base, added = pii.find_spans("+4930123456789 " + "and 4930123456789 or " * copies + "in 2019", field)
    assert len(base) == 1 and len(added) == copies and {k for k, _, _ in added} == {3}
    assert pii.find_spans("order 4930123456789 and 4930123456789 of 2019 2019", field) == ([], [])


def test_training_takes_long_texts_and_null_ids(docs_of):
    rng = random.Random(3)
    rows = [(i, f"{words(rng, 6_000)} 4111111111111111 {words(rng, 5)} 10.0.0.{i} end{i}") for i in range(9)] + [(None, f"mail a{i}@host.org or b{i} 77") for i in range(9)]
    assert min(len(t) for i, t in rows if i is not None) > 20_000
    field, want = pii.train(docs_of(rows)), pii.fit([t for _, t in rows])
    for got, part in ((field.unary, want.unary), (field.chain, want.chain), (field.skip, want.skip)):
        assert np.allclose(got, part, atol=1e-9)
    assert not np.allclose(field.unary, pii.fit([]).unary)


def test_pii_odd_rows(docs_of, odd_rows):
    df = docs_of([*odd_rows, (50, "write to é.x@host.example.org or 10.1.2.3 🙂 +44 20 7946 0958")])
    got = pii.find_pii(df, pii.train(df)).collect()
    assert len(got) == len(odd_rows) + 1
    r = next(x for x in got if x["doc_id"] == 50)
    assert (r["n_email"], r["n_ip"], r["n_phone"]) == (1, 1, 1)
    t = "write to é.x@host.example.org or 10.1.2.3 🙂 +44 20 7946 0958"
    assert t[slice(*map(int, r["spans"].split(",")[0].split(":")[1:]))] == ".x@host.example.org"
    empty = next(x for x in got if x["doc_id"] == 1)
    assert empty["spans"] == "" and empty["base_sha256"] == hashlib.sha256(b"").hexdigest()
    none = df.where("false")
    assert pii.find_pii(none, pii.train(none)).collect() == []


# --------------------------------------------------------------------- chats

MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def test_branches_are_ranked(spark):
    rows = [(1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 3, "user", "c", 0.0), (1, 5, 4, "assistant", "d", -1.0), (1, 6, 4, "assistant", "e", -2.0), (2, 9, 77, "user", None, None), (3, 1, 2, "user", "x", 0.0), (3, 2, 1, "user", "y", 0.0), (None, 1, None, None, "z", 1.0), (4, None, None, "user", "lost", 0.0)]
    got = chat.read_back(chat.format_chats(spark.createDataFrame(rows, MESSAGES), branches=2)).collect()
    by = {(r["tree"], r["rank"]): [(t["role"], t["text"]) for t in r["turns"]] for r in got}
    assert by[1, 1] == [("user", "hi"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    assert by[1, 2] == [("user", "hi"), ("assistant", "b"), ("user", "c"), ("assistant", "e")]
    assert by[2, 1] == [("user", "")] and by[None, 1] == [("", "z")]
    assert (3, 1) not in by and (4, 1) not in by
    assert {(r["tree"], r["rank"]): r["masked"] for r in got}[1, 1] == "bd"


def test_long_path_and_control_strings(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "~0~1~", "a\nb<", "", "|>é🙂"]
    rows = [(1, i, i - 1 if i else None, ("user", "assistant", "odd\nrole<|")[i % 3], hard[i % 5], 0.0) for i in range(100)]
    r = chat.read_back(chat.format_chats(spark.createDataFrame(rows, MESSAGES))).collect()[0]
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[3], x[4]) for x in rows]
    assert r["masked"] == "".join(x[4] for x in rows if x[3] == "assistant")
    assert r["formatted"].count("<|im_start|>") == 100


def test_branches_match_brute_force(spark):
    """Random trees, with long texts and columns whose names are used inside: the best branches, listed one by one."""
    rng = random.Random(31)
    rows = []
    for tree in range(12):
        n = rng.randrange(1, 40)
        rows += [(tree, i, rng.randrange(i) if i and rng.random() < 0.95 else None, rng.choice(["user", "assistant"]), rng.choice(["", "a~b", "x" * 50_000]) + str(i), float(rng.randrange(-3, 4))) for i in range(n)]
    df = spark.createDataFrame(rows, MESSAGES)
    for c in ("leaf", "up", "total", "distance", "rank", "piece", "at", "leads", "led", "x"):
        df = df.withColumn(c, F.lit("clash"))
    got = {(r["tree"], r["rank"]): (r["leaf"], [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.read_back(chat.format_chats(df, branches=3)).collect()}
    want = {}
    for tree in range(12):
        own = {i: (p, role, text, score) for t, i, p, role, text, score in rows if t == tree}
        parents = {p for p, *_ in own.values()}
        ways = []
        for leaf in own.keys() - parents:
            way, at = [], leaf
            while at is not None:
                way.append(at)
                at = own[at][0]
            ways.append((-sum(own[i][3] for i in way), leaf, [own[i][1:3] for i in reversed(way)]))
        for k, (_, leaf, turns) in enumerate(sorted(ways)[:3]):
            want[tree, k + 1] = (leaf, turns)
    assert got == want


def test_linear_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (None, 1, "user", None), (2, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["tree"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.format_chats(chat.linear(df))).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b"), ("assistant", "b")], None: [("user", "")], 2: [("", "x")]}
    assert chat.format_chats(chat.linear(df.where("false"))).collect() == []


# --------------------------------------------------------------------- pages

PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One,\n two<br>three.<p>Four &lt;five&gt; &#233;</article><footer>foot, foot</footer></body></html>", "T & U\n\nOne, two three.\n\nFour <five> é"),
    ("<body><header><h1>Site, of, many, commas</h1></header><div id=content><p>Short text.</p><ul><li>a<li>b</ul></div><div class='sidebar'><p>" + "noise, " * 40 + "</p></div></body>", "Short text.\n\na\n\nb"),
    ("<div class=post><p>Body, of the post.</p><div class='comment-list'><p>" + "I, think, " * 30 + "</p></div><form><p>Name, please</p></form></div>", "Body, of the post."),
    ("<main><p>x</p><aside>y, y</aside><script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>z</p></main>", "x\n\nz"),
    ("<article><p>Real, text here.</p><div role=alert>Cookies, cookies</div><div class=related><a href=1>More</a><a href=2>Less</a></div></article>", "Real, text here."),
    ("<article class=post><div class='post-header'><h1>Title</h1></div><p>Real, text.</p><article class=comment><p>me, too, I, say</p></article></article>", "Title\n\nReal, text."),
    ("plain text, no markup", "plain text, no markup"),
    ("", ""),
    (None, ""),
    ("<nav><a href=x>only menus</a></nav>", ""),
    ("<article><p>never closed <b>bold <i>both", "never closed bold both"),
    ("<p title='a > b'>quoted</p><p data-x=\"<p>\">attr</p>", "quoted\n\nattr"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_extract(page, want):
    assert html_extract.extract(page) == want


@pytest.mark.parametrize("name", ["content has-sidebar", "page no-comments", "site-main with-header", "content sidebar-left", "grid sidebar-layout"])
def test_names_of_furniture_around_the_article(name):
    p = "Words of the article, and more. " * 9
    for inside in (f"<p>{p}</p>", f"<article><p>{p}</p></article>"):
        page = f"<div class='top'>Welcome</div><div class='{name}'>{inside}<div class='sidebar'><p>noise, noise</p></div></div><div class='main-nav'>a, b</div>"
        assert html_extract.extract(page) == p.strip()
    held = f"<div class='x'><p>{p}</p></div>"
    assert html_extract.extract(f"{held}<div id='comments'>{held * 3}</div>") == p.strip()
    html_extract.extract(("<div class='top'>Welcome</div>" + "<div class='sidebar-layout'>a, b" * 2_000))


LONG = "Words of the article, and more. " * 20


@pytest.mark.parametrize(("page", "want"), [
    (f"<main><div><p>{LONG}</p></div><div><p>Short second.</p></div></main>", "Short second."),
    (f"<div><div class=x><p>{LONG}</p></div><div class=x><p>Short second.</p></div></div>", "Short second."),
    (f"<article><p>{LONG}</p><h2>References</h2><ul><li><a href=a>Smith 2001</a><li><a href=b>Doe 2002</a></ul></article>", "References\n\nSmith 2001\n\nDoe 2002"),
    (f"<div class=content><p>{LONG}</p><p class='popular-quote share'>A quote, as it was said.</p></div>", "A quote, as it was said."),
])
def test_no_part_of_the_article_is_lost(page, want):
    assert html_extract.extract(page) == f"{LONG.strip()}\n\n{want}"


def test_links_count_below_any_markup():
    page = "<p><a href=x>" + "<span>" * 30 + "twelve chars" + "</span>" * 30 + "</a> and text</p>"
    assert html_extract.Tree(page).blocks == [(1, "twelve chars and text", 12)]


@pytest.mark.parametrize("unit", ["<p>x, y</p><b>", "<b>", "<div>", "<li>x", "</i><b>x", "<a>x<p>y", "<ul><li><a>x</a>", "<div class='sidebar'>a", "<article class=sidebar>x"])
def test_time_grows_with_the_page(unit):
    """1 MB of elements that never end; with a look at all ancestors for each it would take minutes."""
    began = time.time()
    html_extract.extract(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 10


@pytest.mark.parametrize("unit", ["<a ", "<a b=", "<a '", "</a ", "<a \"", "<!", "</script "])
@pytest.mark.parametrize("before", ["", "<p>text</p>", "text>", "<script>"])
def test_tags_that_never_close_take_no_longer(unit, before):
    began = time.time()
    found = html_extract.extract(before + unit * (1_000_000 // len(unit)))
    assert time.time() - began < 10
    assert "text" in found or "text" not in before


INSERTS = ["<button>SHARE</button>", "<select><option>ONE<option>TWO</select>", "<svg><text>LOGO</text></svg>", "<canvas>NO CANVAS</canvas>", "<video src=x>NO VIDEO</video>", "<span style='display: none'>HIDDEN</span>", "<span hidden>HIDDEN</span>", "<i aria-hidden='true'>ICON</i>", "<span class='advert'>BUY NOW</span>", "<a href=x class='sponsored'>BUY NOW</a>", "<object>PLUGIN</object>", "<template>LATER</template>", "<label hidden><b>DEEP</b></label>"]


@pytest.mark.parametrize("insert", INSERTS)
def test_inline_furniture_is_left_out(insert):
    said = "A paragraph of the article, long enough to count, with a few commas, and an end."
    page = f"<html><body><article><h1>Title</h1><p>{said}</p><p>Another {insert}one, with words before and after it.</p>{insert}<p>{said}</p></article></body></html>"
    assert html_extract.extract(page) == f"Title\n\n{said}\n\nAnother one, with words before and after it.\n\n{said}"


def test_inline_elements_that_are_no_furniture_stay():
    said = "Some <span class='highlight'>marked</span> words, <a class='external link' href=x>a link</a>, <em class='note'>a note</em>, <b class='ad-hoc'>ad hoc</b>, and an end <unended"
    assert html_extract.extract(f"<article><p>{said}") == "Some marked words, a link, a note, ad hoc, and an end <unended"
    assert html_extract.extract("<article><p>One, two.</p><!-- never ends <p>three</p>") == "One, two."
    assert html_extract.extract("<article><p>One, <![CDATA[two & <b>]]> three") == "One, two & <b> three"


def test_scores_match_brute_force():
    """Every block's points, halved for each step up, summed over all ancestors one by one."""
    rng = random.Random(21)
    for _ in range(60):
        page, depth = "", 0
        for _ in range(rng.randrange(2, 40)):
            if rng.random() < 0.3 and depth:
                page, depth = page + "</div>", depth - 1
            elif rng.random() < 0.5:
                page, depth = page + f"<div class='{rng.choice(['', 'content', 'x'])}'>", depth + 1
            else:
                page += f"<{(t := rng.choice(['p', 'h2', 'pre']))}>{'a, b ' * rng.randrange(1, 60)}<a href=x>{'c' * rng.randrange(9)}</a></{t}>"
        tree = html_extract.Tree(page)
        want: dict[int, float] = {}
        chars, links = {}, {}
        for owner, text, linked in tree.blocks:
            node, share = html_extract.container(tree, owner), html_extract.points(tree, owner, text, linked)
            while True:
                want[node] = want.get(node, 0) + share
                if node == 0:
                    break
                node, share = tree.parent[node], share / 2
            for i in [*tree.above(owner), 0]:
                chars[i], links[i] = chars.get(i, 0) + len(text), links.get(i, 0) + linked
        for i in want:
            want[i] += {"div": 5.0}.get(tree.tag[i], 0) + 25.0 * ({"content"} in tree.names[i])
        best, value, score, *_ = html_extract._best(tree, tree.cut(set()))
        assert set(score) == set(want) and all(abs(score[i] - want[i]) < 1e-9 for i in want)
        if want:
            assert abs(value - max(want[i] * (1 - links[i] / max(chars[i], 1)) for i in want)) < 1e-9


def test_extract_table(spark):
    df = spark.createDataFrame([(i, f"u{i}", p, "clash") for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    df = df.unionByName(df.where("page_id = 0")).withColumn("inside", F.lit("kept"))
    assert html_extract.extract_text(df).where("page_id = 0").count() == 2 and "inside" in html_extract.extract_text(df).columns
    got = html_extract.extract_text(df.dropDuplicates(["page_id"])).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [w for _, w in PAGES] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract_text(df.where("false")).collect() == []
    html_extract.extract("<" * 50_000)
    html_extract.extract('<a href="' * 5_000)
    assert len(html_extract.extract("<article>" + "<p>word, word</p>" * 20_000 + "</article>")) > 200_000


# ----------------------------------------------------------- decontamination


def brute_tiles(doc, item, least):
    """Greedy tiling by looking at all pairs of positions."""
    used_d, used_i, total = set(), set(), 0
    while True:
        best, found = 0, []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and doc[d + n] == item[i + n] and d + n not in used_d and i + n not in used_i:
                    n += 1
                if n > best:
                    best, found = n, []
                if n and n == best:
                    found.append((i, d))
        if best < least:
            return total
        for i, d in found:
            if not used_d & set(range(d, d + best)) and not used_i & set(range(i, i + best)):
                used_d |= set(range(d, d + best))
                used_i |= set(range(i, i + best))
                total += best


def test_tiles_match_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 16))]
        doc = [rng.randrange(6) for _ in range(rng.randrange(1, 25))]
        if rng.random() < 0.5:
            k = rng.randrange(len(item))
            doc[3:3] = item[k:] + item[:k]
        got = sum(n for _, _, n in decontam.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 3))
        assert got == brute_tiles(doc, item, 3)


def test_decontaminate(docs_of, spark, odd_rows):
    rng = random.Random(2)
    items = [(k, words(rng, 30, 5000).capitalize()) for k in range(8)] + [(50, None), (51, ""), (None, "nothing at all here to see")]
    first = items[0][1].split()
    rows = [(100, f"{words(rng, 50)} {items[3][1].upper()}! {words(rng, 20)}"), (101, " ".join([*first[15:], "between", *first[:15]])), (102, words(rng, 300)), (103, " ".join(first[:10]) + words(rng, 30)), *odd_rows]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (32 << 20, 300):
        got = {r["doc_id"]: r for r in decontam.decontaminate(docs_of(rows), bench, block_bytes=size).collect()}
        assert (got[100]["contaminated"], got[100]["item_id"], got[100]["coverage"]) == (True, 3, 1.0)
        assert (got[101]["contaminated"], got[101]["item_id"]) == (True, 0)
        assert not got[102]["contaminated"] and got[102]["item_id"] is None
        assert not got[103]["contaminated"] and 0.3 <= got[103]["coverage"] < 0.5
        assert sum(r["contaminated"] for r in got.values()) == 2
        assert decontam.drop_contaminated(docs_of(rows), bench, block_bytes=size).count() == len(rows) - 2
    assert decontam.decontaminate(docs_of(rows), bench.where("false")).where("contaminated").count() == 0
    assert decontam.decontaminate(docs_of(rows).where("false"), bench).collect() == []


def test_common_phrases_are_not_tiled(docs_of, spark, monkeypatch):
    """The best of many items that share one phrase, tiled only where it can win."""
    rng = random.Random(14)
    phrase = "as it was said in the book of all things"
    items = [(i, f"{phrase} {words(rng, 40)}") for i in range(200)]
    docs = [(1, f"{words(rng, 30)} {items[77][1]} {words(rng, 30)}"), (2, f"{words(rng, 20)} {phrase} {words(rng, 20)}")]
    got = {r["doc_id"]: r for r in decontam.decontaminate(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (got[1]["item_id"], got[1]["coverage"], got[1]["contaminated"]) == (77, 1.0, True)
    assert (got[2]["item_id"], got[2]["contaminated"]) == (0, False) and 0 < got[2]["coverage"] < 0.5
    import pyarrow as pa

    _, names, index = decontam.index_block(items, 5)
    doc, at = decontam.tokens(pa.array([d[1] for d in docs]))
    for k in range(2):
        own = doc[at[k] : at[k + 1]]
        most = dict((i, m) for m, i in decontam.promise(own, names, index))
        for i, x in enumerate(names):
            assert sum(n for *_, n in decontam.tile(own, x, 5)) / x.size <= most.get(i, 0) + 1e-12


def test_items_without_id_contaminate(docs_of, spark):
    rng = random.Random(5)
    item, other, both = (words(rng, 30, 5000) for _ in range(3))
    bench = spark.createDataFrame([(None, item), (None, both), (1, other), (2, both), (None, None)], "item_id long, text string")
    rows = [(1, f"{words(rng, 9)} {item}"), (2, other), (3, both), (4, words(rng, 40))]
    for size in (32 << 20, 300):
        got = {r["doc_id"]: (r["contaminated"], r["item_id"], r["coverage"]) for r in decontam.decontaminate(docs_of(rows), bench, block_bytes=size).collect()}
        assert got == {1: (True, None, 1.0), 2: (True, 1, 1.0), 3: (True, 2, 1.0), 4: (False, None, 0.0)}
        assert [r["doc_id"] for r in decontam.drop_contaminated(docs_of(rows), bench, block_bytes=size).collect()] == [4]


def test_rows_with_one_id_are_judged_apart(docs_of, spark):
    rng = random.Random(7)
    items = [(k, words(rng, 30, 5000)) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, words(rng, 40)), (1, items[4][1]), (None, words(rng, 40)), (None, items[0][1]), (None, words(rng, 40)), (2, f"{items[5][1]} {items[1][1]}")]
    for size in (32 << 20, 300):
        got = decontam.decontaminate(docs_of(rows), bench, block_bytes=size).collect()
        assert sorted((r["doc_id"] or 0, r["contaminated"], r["item_id"] if r["contaminated"] else -1) for r in got) == [(0, False, -1), (0, False, -1), (0, True, 0), (1, False, -1), (1, True, 4), (2, True, 1)]


# ----------------------------------------------------- quality and languages


def test_quality_learns(docs_of, spark, odd_rows):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        rows.append((i, words(rng, 60).capitalize() + "." if good else rng.choice(["WORD!! ", "spam ", "a | b | "]) * 40))
        labels.append((i, int(good)))
    df = docs_of([*rows, *[(1000 + i if i is not None else None, t) for i, t in odd_rows]])
    lab = spark.createDataFrame([*labels, (None, 1), (7000, None)], "doc_id long, quality int")
    model = quality.train(df, lab)
    got = {r["doc_id"]: r for r in quality.score_quality(df, model).collect()}
    test = [(i, y) for i, y in labels if got[i]["held_out"]]
    assert len(test) > 40 and all(got[i]["predicted"] == y for i, y in test)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["held_out"] is False
    assert quality.quality_filter(df, model).columns == df.columns
    x, y = np.random.default_rng(1).normal(size=(500, 3)), None
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    fitted = quality.fit(x, y)
    assert ((fitted.score(x) > 0.5) == y).mean() > 0.9 and fitted.pairs[0][:2] == (0, 1)
    none = quality.train(df.where("false"), lab)
    assert none.score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5
    assert quality.score_quality(df.where("false"), none).collect() == []


def test_languages(docs_of, spark, odd_rows):
    rng = random.Random(5)
    sounds = {"en": ["the", "ing", "and", "th", "er"], "fr": ["é", "eau", "que", "ou", "ment"], "de": ["sch", "ung", "ß", "ein", "ü"]}
    make = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(6, 40)))
    rows = [(i, make(lang), lang, None, 0) for i in range(240) for lang in [rng.choice(["en", "fr", "de"])]]
    df = spark.createDataFrame(rows, DOCS)
    out = quality.held_out("doc_id", 3, 1)
    known = langid.learn_languages(df.where(~out))
    got = langid.identify_languages(df.where(out), known).join(df, "doc_id").select("lang_pred", "lang", "score").collect()
    assert len(got) > 50 and all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in langid.identify_languages(docs_of([*odd_rows, (60, "12 34 !!")]), known).collect()}
    assert odd[1]["lang_pred"] == odd[2]["lang_pred"] == odd[60]["lang_pred"] == "und" and odd[60]["score"] == 0
    assert langid.identify_languages(df, {}).where("lang_pred != 'und'").count() == 0
    assert langid.learn_languages(df.where("false")) == {}


def test_trigrams_in_pieces_give_the_same(monkeypatch):
    texts_ = ["the quick brown fox " * 9, "", "el perro y la niña", "文字 と 言葉 " * 40, "été " * 7]
    raw = np.frombuffer("".join(texts_).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts_)])
    letters = langid.letter_vectors()
    whole = langid.bundles(raw, offs, letters)
    monkeypatch.setattr(langid, "GRAMS", 3)
    pieces = langid.bundles(raw, offs, letters)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces, strict=True)) and whole[0].any()


def test_bundle_is_the_sum_of_bound_trigrams():
    letters = langid.letter_vectors()
    raw = np.frombuffer(b"ab, cab  ", np.uint8)
    v, has = langid.bundles(raw, np.array([0, 2, 9]), letters)
    for k, s in enumerate(([0, 1, 2, 0], [0, 3, 1, 2, 0])):
        want = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(s, s[1:], s[2:], strict=False))
        assert np.array_equal(v[k], want), k
    assert has.all()


KEY = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"


@pytest.mark.parametrize("said", [f'token = "{KEY}"', f"client_secret: {KEY}", f"AWS_SECRET_ACCESS_KEY={KEY}", f'"api-key" : "{KEY}"', f"apikey='{KEY}'", f"token{' ' * 400}={' ' * 400}{KEY}", f"x\npassword={KEY}", f"accessToken.token: {KEY}"])
def test_secrets_are_found_however_far_their_name(said):
    assert pii._assigned(said, said.index(KEY))


@pytest.mark.parametrize("said", [f"monkey = {KEY}", f"token\n= {KEY}", f"token {KEY}", f"tokens = {KEY}", KEY, f"= {KEY}", f"token =\n{KEY}"])
def test_other_words_before_are_no_names(said):
    assert not pii._assigned(said, said.index(KEY))


def test_many_base_spans_take_time_in_proportion():
    text = "a@b.cc " * 60_000
    nodes = [(7 * i, 7 * i + 6, i) for i in range(60_000)]
    began = time.time()
    assert pii.token_labels(nodes, [(0, s, e) for s, e, _ in nodes]).all() and time.time() - began < 5
    assert len(text) == 7 * 60_000
