"""Operators against brute force and against the public libraries, with odd, empty and long texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from rows import same_rows
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, hamming_search, html_extract, license_scan, near_dedup, rule_ensemble, rule_ledger, source_mixing, suffix_dedup, token_counts
from tidemark.llm.induced_sort import sort_suffixes
from tidemark.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every kind of odd text, and a column whose name the operators use."""
    import random

    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "ä€𝄞", "it's", "x", "###", "license", "all", "rights", "reserved"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(4000)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(300))
    near = base.replace(base.split()[150], "other", 1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = [None, "", " \n\t ", "a", text(5), text(60), long, long, base, base, near, "x" * 500, "ab " * 300, "line one\nline one\nLINE", "a\u00a0b'll 've\r\n  end  ", "head " + passage + " tail", passage + text(30), "ALL CAPS!! " * 40]
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}" if i % 5 else None, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_words bigint")


WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(name, spark, sf, duck):
    same_rows(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])


def _texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_ledger(docs):
    got = {r.doc_id: r for r in rule_ledger.apply_policy(rule_ledger.build_ledger(docs)).collect()}
    for i, t in _texts(docs).items():
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert g.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (g.kept and g.base_failed)


def test_policies_and_ablation(docs):
    ledger = rule_ledger.build_ledger(docs)
    n = docs.count()
    for r in rule_ledger.compare_policies(ledger).collect():
        assert r.kept + r.rejected == n
    bits = [r.fail_bits & rule_ledger.DEFAULT_POLICY.mask for r in ledger.collect()]
    for r in rule_ledger.ablate(ledger).collect():
        mask = next(x.mask for x in rule_ledger.RULES if x.name == r.rule)
        assert (r.n_failed, r.n_only) == (sum(b & mask > 0 for b in bits), sum(b == mask for b in bits))


def test_ledger_is_native(docs):
    plan = rule_ledger.build_ledger(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_token_counts(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path, token_limit=100).collect()}
    for i, t in _texts(docs).items():
        assert got[i].n_tokens == len(lib.encode(t or "")) and got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 100)
    counter = token_counts.piece_counter(path)
    rng = random.Random(5)
    for _ in range(2000):
        t = "".join(rng.choice(" \n\t ▁abcdeth.!é①🎉\x00<s>") for _ in range(rng.randrange(30)))
        assert counter.count(t) == len(lib.encode(t))


def test_byte_bpe(docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ours = byte_bpe.rank_encoder(path)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.rank, special_tokens={})
    rng = random.Random(6)
    texts = ["".join(rng.choice(" \n\t ''strevemlld1٣²!é🎉\x00\xa0\u3000是SRE") for _ in range(rng.randrange(30))) for _ in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode_batch(texts)] == [lib.encode_ordinary(t) for t in texts]
    for r in byte_bpe.encode_documents(docs, path).collect():
        raw = (r.text or "").encode()
        assert r.ids == lib.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(raw).hexdigest() and r.n_words == 7
    long = "é" * 3000
    assert np.frombuffer(ours.encode(long), "<u4").tolist() == lib.encode_ordinary(long)


def test_licenses(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    for i, t in _texts(docs).items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        at = [(k, label) for k in range(len(w)) for p, label in license_scan.BASE_PHRASES.items() if w[k : k + len(p.split())] == p.split()]
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert g.base_labels == ",".join(sorted({x for _, x in at})) and 0 <= g.score <= 1


def test_license_labels(spark):
    rows = [(1, "Released under the MIT License."), (2, "so: Licensed under the Apache License, Version 2.0. ok"), (3, "mit license released"), (4, "licensed under CC BY 4.0"), (5, "GNU General Public License")]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: "mit", 2: "apache-2.0", 3: "", 4: "cc-by", 5: "gpl"}


def test_licenses_against_all_starts(spark, sf):
    """Labels and scores of every template tried at every start, weights counted anew."""
    import math

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    rng = random.Random(21)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    for k, (_, text, _) in enumerate(license_scan.TEMPLATES):  # whole, with words lost or changed, cut off, and amid other text
        words = text.split()
        broken = [w if rng.random() > 0.04 else "changed" for w in words]
        texts += [(-5 * k - 1, text), (-5 * k - 2, " ".join(broken)), (-5 * k - 3, " ".join(words[: len(words) * 2 // 3])), (-5 * k - 4, " ".join(words[1:])), (-5 * k - 5, f"mit license, all of it. {text} {text}")]
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    words = {i: cut(t) for i, t in texts}
    df = Counter(w for ws in words.values() for w in set(ws))
    weight = lambda w: math.log((1 + len(texts)) / (1 + df[w])) + 1e-3
    seen = set()
    for r in license_scan.scan_licenses(d).collect():
        ws, labels, score = words[r.doc_id], set(r.base_labels.split(",")) - {""}, 1.0 if r.base_labels else 0.0
        for label, text, phrases in license_scan.TEMPLATES:
            template = cut(text)
            keys = [(next(i for i in range(len(template)) if template[i : i + len(p)] == p), p) for p in map(cut, phrases)]
            for start in range(-len(template), len(ws)):
                if all(start + p >= 0 and ws[start + p : start + p + len(x)] == x for p, x in keys):
                    there = sum(weight(w) for k, w in enumerate(template) if 0 <= start + k < len(ws) and ws[start + k] == w)
                    cover = min(1.0, there / sum(map(weight, template)))
                    if cover >= license_scan.MIN_COVER:
                        labels.add(label)
                        score = max(score, cover)
        assert (r.labels, r.score) == (",".join(sorted(labels)), pytest.approx(score))
        seen |= labels
    assert seen == {label for label, _, _ in license_scan.TEMPLATES} | set(license_scan.BASE_PHRASES.values())


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("just  text &amp; more", "just text & more"),
        ("<html><head><title>x</title></head><body><nav><a href=/>menu</a></nav><article><h1>A  b</h1><p>c<br>d<p>e</article><footer>f</footer>", "A b\nc d\ne"),
        ("<body><div class='sidebar'>s</div><div class=content><section><p>One two three.</p><p>Four five.</p></section><section><p>Six seven eight nine.</p></section></div><div id=comments><p>c</p></div></body>", "One two three.\nFour five.\nSix seven eight nine."),
        ("<main><h1>T</h1><form>f</form><script>var t='</p>';</script><p hidden>h</p><p>x &lt; y</p></main>", "T\nx < y"),
    ],
)
def test_pages(page, text):
    assert html_extract.main_text(page) == text


MENU = "<ul>" + "".join(f"<li><a href=/{i}>menu item{i}</a>" for i in range(10)) + "</ul>"
SOURCES = "<ul><li><a href=/1>First source</a><li><a href=/2>Second source</a><li><a href=/3>Third source</a></ul>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><div id=page>{MENU}<article><p>Short text.</p></article></div></body>", "Short text."),
        (f"<body><div><div>{MENU}</div><div><p>Short text.</p></div></div></body>", "Short text."),
        (f"<body><main>{MENU}<article><p>Short text.</p></article></main></body>", "Short text."),
        (f"<body>{MENU}<article><p>Text.</p>{SOURCES}<p><a>one</a> <a>two</a> <a>three</a></p></article></body>", "Text.\nFirst source\nSecond source\nThird source\none two three"),
        (f"<body><div>{MENU}</div><div><p>A text of some words, long enough.</p>{SOURCES}</div></body>", "A text of some words, long enough.\nFirst source\nSecond source\nThird source"),
        ("<body><ul><li><a>Home</a><li><a>Shop</a><ul><li><a>Shoes</a><li><a>Hats</a><li><a>Coats</a></ul></ul><article><p>Short text.</p></article></body>", "Short text."),
    ],
)
def test_link_lists(page, text):
    assert html_extract.main_text(page) == text


LONG = "A paragraph of the article that has a good many words in it, as articles do, so that it is dense."


@pytest.mark.parametrize(
    "tag, name, stays",
    [
        ("h2", "class='section-header'", True),
        ("h2", "class='header'", True),
        ("p", "class='notice'", True),
        ("div", "class='share-price'", True),
        ("section", "id='related-work'", True),
        ("p", "class='ad-hoc'", True),
        ("td", "class='social'", True),
        ("div", "class='comment'", True),
        ("div", "class='wide relatedPosts'", False),
    ],
)
def test_class_words(tag, name, stays):
    inner = LONG if stays else "<a>A post</a> <a>And one more</a>"
    part = f"<{tag} {name}>{inner}</{tag}>"
    part = f"<table><tr>{part}</table>" if tag == "td" else part
    lines = [LONG, LONG, LONG] if stays else [LONG, LONG]
    assert html_extract.main_text(f"<body><article><p>{LONG}</p>{part}<p>{LONG}</p></article></body>") == "\n".join(lines)


@pytest.mark.parametrize("name", ["share-price", "related-work", "ad-hoc", "section-header"])
def test_class_words_outside_articles(name):
    page = lambda c: f"<body><div><div><p>{LONG}</p></div><div class='{c}'><p>{LONG}</p></div></div></body>"
    assert html_extract.main_text(page(name)) == f"{LONG}\n{LONG}"
    for other in ("ad", "site-header", "relatedPosts", "ad_box-2", "comments x"):
        assert html_extract.main_text(page(other)) == LONG


def made_pages(n=40):
    """Well-formed pages whose article no name gives away: it stands among menus, short facts and a dense line or two, at any depth."""
    rng = random.Random(17)
    say = lambda k: " ".join(rng.choice(("salt", "harbour", "of", "winter", "a", "letters", "the", "grey", "engine")) for _ in range(k))
    for _ in range(n):
        menu = "<ul>" + "".join(f"<li><a href='/{k}'>{say(2)}</a></li>" for k in range(rng.randrange(4, 15))) + "</ul>"
        facts = "<div>" + "".join(f"<div><b>{say(1)}</b> <b>{say(1)}</b></div>" for _ in range(rng.randrange(14, 25))) + "</div>"
        text = "".join(f"<p>{say(rng.randrange(30, 80))} <b>{say(2)}</b> {say(20)} <a href='/x'>{say(1)}</a></p>" for _ in range(rng.randrange(4, 10)))
        parts = [menu, facts, f"<section>{text}</section>", f"<table><tr><td>{say(9)}</td></tr></table>"]
        rng.shuffle(parts)
        html = "".join(parts)
        for _ in range(rng.randrange(3)):
            html = f"<div>{menu if rng.random() < 0.5 else ''}{html}</div>"
        yield f"<html><body>{html}</body></html>", text


def naive_choice(html):
    """The element of the greatest sum of child densities, recomputed from the definition by recursion."""
    import math
    import xml.etree.ElementTree as E

    def counts(e, linked=False):
        linked |= e.tag == "a"
        own = [e.text or "", *(c.tail or "" for c in e)]
        n = sum(len(t) for t in own if t.strip())
        c, t, lc, lt = n, 0, n if linked else 0, 0
        for x in e:
            xc, xt, xlc, xlt = counts(x, linked)
            c, t, lc, lt = c + xc, t + xt + 1, lc + xlc, lt + xlt + (linked or x.tag == "a")
        return c, t, lc, lt

    body = E.fromstring(html).find("body")
    bc, _, blc, _ = counts(body)

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        base = lc * c / max(1, c - lc) + blc / bc * c + math.e
        return c / max(1, t) * math.log(max(1, c / max(1, lc) * max(1, t) / max(1, lt))) / max(0.1, math.log(math.log(base)))

    inline = ("a", "b")
    best = (-1.0, None)
    for e in body.iter():
        if e.tag in inline:
            continue
        own = E.Element("x")
        own.text, own[:] = e.text, [x for x in e if x.tag in inline]
        total = density(*counts(own)) + sum(density(*counts(x)) for x in e if x.tag not in inline)
        if total > best[0] + 1e-6:
            best = (total, e)
    return best[1]


def test_density_decides():
    changed = 0
    for html, text in made_pages():
        expected = [" ".join(x.split()) for x in re.sub(r"<[^p/][^>]*>|</[^p>]*>", "", text).replace("<p>", "").split("</p>") if x]
        got = html_extract.main_text(html)
        assert got.split("\n") == expected
        lines = [" ".join("".join(x.itertext()).split()) for x in naive_choice(html)]
        assert lines == expected
        changed += html_extract.main_text(html, lambda *counts: 1.0) != got
    assert changed >= 30


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<b>", "<li>", "<a href='x", '<p class="x', "<!--", "<script>", "<table><td>", "</p><div>", "<b><hr>", "&#", "<", "<div class=ad>x", "<p hidden "])
def test_broken_pages_take_linear_time(piece):
    import time

    start = time.process_time()
    html_extract.main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 20  # a quadratic reading takes hours


def test_quotes_in_tags():
    assert html_extract.main_text("<p class=it's>Hello world\nSecond") == "Hello world Second"
    assert html_extract.main_text("<p title='a > b' x=\"'\">one</p><p y='>two") == "one\ntwo"
    assert html_extract.main_text("<p>1 < 2 <!-- <p>no --> and <!doctype x> 3 </ 4><?x?></p>") == "1 < 2 and 3"


def test_blocks_beside_the_article():
    article = f"<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article>"
    for other in ("<div>Buy the new kettle today, it is good.</div>", "<div class=author-box><p>Ann writes.</p></div>", "<div class=related-content><ul><li><a href=/1>One more</a><li><a href=/2>And another</a><li><a href=/3>A third</a></ul></div>"):
        for page in (f"<main>{other}{article}</main>", f"<main>{article}{other}</main>", f"<div>{article}{other}</div>"):
            assert html_extract.main_text(f"<body>{page}</body>") == "\n".join([LONG] * 3)


def test_page_columns(spark):
    d = spark.createDataFrame([(1, "u", "<p>é", "old"), (1, "u", "<p>é", "old"), (2, None, None, None)], "page_id int, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract_text(d).collect()) == [(1, "é", 1), (1, "é", 1), (2, "", 0)]


def test_suffix_sorting():
    rng = np.random.default_rng(1)
    for k in range(150):
        t = rng.integers(0, 1 + k % 4, rng.integers(0, 60))
        t = np.concatenate([t, t, t[:7]]) if k % 3 == 0 else t
        order, common = sort_suffixes(t, budget=64 if k % 2 else 1 << 20)
        s = t.tolist()
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        for a, b, c in zip(order, order[1:], common[1:], strict=False):
            assert s[a : a + c] == s[b : b + c] and (s[a + c : a + c + 1] != s[b + c : b + c + 1] or a + c == b + c)


def test_long_common_prefixes():
    rng = np.random.default_rng(3)
    piece = rng.integers(0, 250, 700)
    t = np.concatenate([piece, [255], piece, [254], piece[100:], piece[:333]])
    order, common = sort_suffixes(t)
    s = t.tolist()
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    for a, b, c in zip(order, order[1:], common[1:], strict=False):
        assert s[a : a + c] == s[b : b + c] and s[a + c : a + c + 1] != s[b + c : b + c + 1]
    assert common.max() == 700


def brute_spans(texts, length=200):
    seen = Counter(t[k : k + length] for t in texts.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in texts.items():
        mark = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                mark[k : k + length] = b"\1" * length
        left = bytes(c for c, m in zip(t, mark, strict=True) if not m)
        out[i] = (len(t), sum(mark), len(re.findall(rb"\x01+", bytes(mark))), hashlib.sha256(left).hexdigest())
    return out


def test_substrings(docs):
    expected = brute_spans({i: (t or "").encode() for i, t in _texts(docs).items()})
    got = {r.doc_id: r for r in suffix_dedup.dedup_substrings(docs).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == expected
    assert got[0].text is None and got[6].text == "" and got[10].n_words == 7


def test_substrings_of_any_rows(spark):
    """Null, repeated and textual ids; columns of the names that the operator uses; texts of several hundred thousand bytes."""
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passage, long = say(262), say(300_000)
    texts = [passage, passage, say(50) + passage, None, "", long, say(10) + long[1000:250_000], say(10), say(10)]
    ids = [1, None, 1, None, 2, 2, 3, 4, 4]
    rows = [(i, t, f"k{k}", k, k, k, k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, id string, row int, rest int, start int, n_removed int")
    expected = brute_spans({k: (t or "").encode() for k, t in enumerate(texts)})
    got = suffix_dedup.dedup_substrings(d)
    assert got.columns == ["doc_id", "text", "id", "row", "rest", "start", *suffix_dedup.MADE]
    got = got.collect()
    assert {r.row: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == expected
    assert all((r.id, r.rest, r.doc_id) == (f"k{r.row}", r.row, ids[r.row]) for r in got)
    named = suffix_dedup.dedup_substrings(d, id_column="id").collect()
    assert {r.row: r.kept_sha256 for r in named} == {r.row: r.kept_sha256 for r in got}


def test_substrings_of_hot_leads(spark, monkeypatch):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefghij") for _ in range(230))
    texts = {i: "".join(rng.choice("abcdefghij") for _ in range(150)) + passage[: 230 - i % 40] + "".join(rng.choice("abcdefghij") for _ in range(150)) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    expected = brute_spans({i: t.encode() for i, t in texts.items()})
    for limit in (20_000, 5):
        monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", limit)
        got = suffix_dedup.dedup_substrings(docs, with_text=False).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == expected


def test_shared_reach():
    assert suffix_dedup.shared_reach(np.zeros(3, np.int64), [b"x" + bytes(5), b"x", b"x" + bytes(5)], 8).tolist() == [6, 1, 6]
    rng = random.Random(9)
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    for _ in range(200):
        sides = [bytes(rng.choice((0, 0, 0, 1)) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 12))]
        leads = np.array([rng.randrange(2) for _ in sides], np.int64)
        expected = [max((common(a, b) for j, b in enumerate(sides) if j != i and leads[i] == leads[j]), default=0) for i, a in enumerate(sides)]
        assert suffix_dedup.shared_reach(leads, sides, 6).tolist() == expected


def words_in_common(x, y):
    """Length of the longest common subsequence, cell by cell."""
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + (a == b))
    return row[-1]


def similar_pairs(texts, least=0.8):
    """Pairs of different texts by brute force, with words cut by another rule of the same meaning."""
    words = {i: re.findall(r"[^\x00-\x20]+", t.lower()) for i, t in texts.items() if t}
    bags = {i: Counter(w) for i, w in words.items() if w}
    out = {}
    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            most = max(len(words[a]), len(words[b]))
            if words[a] != words[b] and (bags[a] & bags[b]).total() >= least * most - 1e-9:
                s = words_in_common(words[a], words[b]) / most
                if s >= least - 1e-9:
                    out[a, b] = s
    return words, out


def check_classes(texts, got, recall):
    words, pairs = similar_pairs(texts)
    label = {i: i for i in texts}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    first = {}
    for a, b in [*((first.setdefault(tuple(w), i), i) for i, w in sorted(words.items()) if w), *pairs]:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    for i, c in got.items():  # nothing is joined that similar pairs do not connect, and a class is named by its least id
        assert find(c) == find(i) and got[c] == c and c <= i
    assert sum(got[a] == got[b] for a, b in pairs) >= recall * len(pairs)
    for w in set(map(tuple, words.values())):
        assert len({got[i] for i in words if tuple(words[i]) == w}) == 1
    return len(pairs)


def test_near_duplicates(docs, spark, sf):
    for d, recall in ((docs, 1), (spark.read.parquet(f"{sf}/documents.parquet"), 0.9)):
        texts = _texts(d)
        got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(d).collect()}
        assert set(got) == set(texts) and check_classes(texts, got, recall)


def test_near_duplicates_around_a_common_passage(spark):
    """Buckets of more than COLD texts: a passage that all share, near copies among them, and copies of a copy."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(120):
        own = [word() for _ in range(rng.randrange(40, 60))]
        texts.append(own[:20] + passage + own[20:])
    for t in texts[:40]:
        near = list(t)
        for _ in range(4):
            near[rng.randrange(len(near))] = word()
        texts.append(near)
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(d).collect()}
    assert check_classes(texts, got, 0.95) >= 40 and max(Counter(got.values()).values()) < 5


def crowd(seed):
    """Texts of one passage, and of some a copy with every third of its other words changed: pairs of little more than 0.8 that meet in crowded buckets only."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(50)]
    texts = []
    for _ in range(90):
        own = [word() for _ in range(60)]
        texts.append(own[:30] + passage + own[30:])
    for t in texts[:45]:
        texts.append([word() if not 30 <= k < 80 and k % 3 == 0 else w for k, w in enumerate(t)])
    return {i: " ".join(t) for i, t in enumerate(texts)}


def lost_in_crowds(texts, got):
    """Similar pairs that share a band but no class, and the number of similar pairs that share one."""
    words = {i: near_dedup.normal_words(t) for i, t in texts.items()}
    keys = {i: set(near_dedup.band_keys(near_dedup.shingle_hashes(w)).tolist()) for i, w in words.items()}
    pairs = [(a, b) for a in words for b in words if a < b and keys[a] & keys[b] and near_dedup.aligned_similarity(words[a], words[b]) >= 0.8]
    return [(a, b) for a, b in pairs if got[a] != got[b]], len(pairs)


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    texts = crowd(31)
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(d).collect()}
    assert lost_in_crowds(texts, got) == ([], 45) and Counter(got.values()).most_common(1)[0][1] == 2
    monkeypatch.setattr(near_dedup, "CROWD_BLOCK", 20)  # several blocks a bucket, and ids that are strings
    named = near_dedup.near_duplicates(d.selectExpr("concat('k', 1000 + doc_id) doc_id", "text"))
    assert {int(r.doc_id[1:]) - 1000: int(r.class_id[1:]) - 1000 for r in named.collect()} == got


def test_crowded_buckets_make_no_row_a_pair(spark, monkeypatch):
    """Texts that are too much alike for their marks to tell them apart: their pairs stay in cells, and all links are found."""
    from tidemark.llm.common import Stash

    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(74)]
    texts = [[*(word() for _ in range(13)), *passage, *(word() for _ in range(13))] for _ in range(120)]
    texts += [[word() if k in (2, 5, 40, 91, 97) else w for k, w in enumerate(t)] for t in texts[:30]]
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows, save = {}, Stash.save

    def counted(self, df, name):
        out = save(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Stash, "save", counted)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(d).collect()}
    lost, n = lost_in_crowds(texts, got)
    assert not lost and n >= 30 and check_classes(texts, got, 1) >= 30
    assert rows["sized"] and sum(n for name, n in rows.items() if name.startswith("pairs-")) < 150 * near_dedup.COLD // 2 < 150 * 149 // 4
    assert rows["links-crowded"] < 150


def test_all_buckets_in_cells(spark, monkeypatch):
    """Cells find what rows of pairs find, in blocks bounded by members or by words."""
    d = spark.createDataFrame(list(crowd(31).items()), "doc_id bigint, text string")
    found = []
    for cold, block, words in ((1 << 30, 1024, 1 << 20), (1, 5, 1 << 20), (1, 1024, 600)):
        for name, value in (("COLD", cold), ("CROWD_BLOCK", block), ("CROWD_WORDS", words), ("MEMO_WORDS", 200)):
            monkeypatch.setattr(near_dedup, name, value)
        found.append({r.doc_id: r.class_id for r in near_dedup.near_duplicates(d).collect()})
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) == 90


def test_components(spark):
    from tidemark.llm.common import Stash
    from tidemark.llm.components import components

    rng = random.Random(5)
    order = list(range(300, 420))
    rng.shuffle(order)
    links = [*((i, i + 1) for i in range(100)), *((200, 200 + i) for i in range(1, 60)), *zip(order, order[1:], strict=False), (7, 7), (50, 3)]
    got = components(spark.createDataFrame(links, "a bigint, b bigint"), Stash(spark, "test"), "c").collect()
    assert {r.id: r.label for r in got} == {**dict.fromkeys(range(101), 0), **dict.fromkeys(range(200, 260), 200), **dict.fromkeys(range(300, 420), 300)}


def test_near_duplicates_of_odd_ids(spark):
    texts = [("b", "one two three four five six seven eight nine ten"), ("a", "One two  three four five six seven eight nine ten"), (None, "one two three four five six seven eight nine ten"), ("c", "x")]
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "key string, body string"), id_column="key", text="body").collect()
    assert {r.key: (r.class_id, r.copy_of) for r in got} == {"a": ("a", "a"), "b": ("a", "a"), "c": ("c", "c")}


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(2)  # the digest of the first text is the greater
    base, other, third = ([f"{c}{rng.randrange(900)}" for _ in range(120)] for c in "bao")
    near = lambda w, k: " ".join(w[:k] + ["new"] + w[k + 1 :])
    texts = [(1, " ".join(other)), (1, " ".join(base)), (2, near(base, 60)), (3, near(other, 60)), (4, None), (4, " ".join(third)), (5, near(third, 30))]
    expected = {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}  # of id 1 the text in a counts, as it is the first
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert "n_links" not in got.columns and {r.doc_id: r.class_id for r in got.collect()} == expected


def test_alignment():
    a = [b"%d" % i for i in range(100)]
    assert near_dedup.aligned_similarity(a, a) == 1
    assert near_dedup.aligned_similarity(a, a[:50] + [b"new"] + a[51:]) == pytest.approx(0.99)
    assert near_dedup.aligned_similarity(a, a[50:] + a[:50]) == 0
    assert near_dedup.aligned_similarity([b"x"], [b"y"]) == 0 and near_dedup.aligned_similarity([], []) == 0
    rng = random.Random(8)
    for _ in range(300):
        x = [rng.choice((b"p", b"q", b"r")) for _ in range(rng.randrange(1, 25))]
        y = [w for w in x if rng.random() > 0.1] + [b"z"] * rng.randrange(3)
        s = words_in_common(x, y) / max(len(x), len(y))
        assert near_dedup.aligned_similarity(x, y) == pytest.approx(s if s >= 0.8 - 1e-9 else 0)


def test_top_k(spark):
    rng = random.Random(4)
    centre = [rng.getrandbits(64) for _ in range(20)]
    code = lambda: (rng.choice(centre) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6)))) % (1 << 64)
    rows = [(i, c - (1 << 64) if c >= 1 << 63 else c) for i, c in enumerate([code() for _ in range(300)] + [5] * 60)] + [(999, None)]
    d = spark.createDataFrame(rows, "id bigint, code bigint")
    got = hamming_search.search(d, d.where("id % 20 = 0"), k=7).collect()
    expected = []
    for q, c in rows:
        if q % 20 == 0 and c is not None:
            near = sorted(((c ^ x) & (1 << 64) - 1).bit_count() * 10**6 + i for i, x in rows if x is not None)[:7]
            expected += [(q, k + 1, v % 10**6, v // 10**6) for k, v in enumerate(near)]
    assert sorted(tuple(r) for r in got) == sorted(expected)
    with pytest.MonkeyPatch.context() as m:  # the scan of open queries from the second step on, in small blocks
        m.setattr(hamming_search, "MAX_FLIPS", 100)
        m.setattr(hamming_search, "SCAN_BLOCK", 3)
        assert sorted(tuple(r) for r in hamming_search.search(d, d.where("id % 20 = 0"), k=7).collect()) == sorted(expected)
    few = spark.createDataFrame([(0, 1), (1, 7)], "id bigint, code bigint")
    assert hamming_search.search(few, few.where("id = 0"), k=7).count() == 2
    assert hamming_search.search(few.where("id > 5"), few, k=7).count() == 0


def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) / len(got) > 0.95


def test_classifier_scores_are_sums_of_rules(docs, spark, sf):
    """Every score recomputed from the rules' weights over statistics that are counted anew."""
    import math

    every = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = rule_ensemble.train(every, spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.rules
    for d in (docs, every):
        got = {r.doc_id: r for r in rule_ensemble.score(d, model).collect()}
        for i, t in _texts(d).items():
            t = t or ""
            w = WORD.findall(t)
            windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
            cover = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
            lines = [x for x in t.split("\n") if WORD.search(x)]
            chars, one = sum(map(len, w)), lambda n: max(n, 1)
            upper = len(regex.findall(r"\p{Lu}", t))
            x = {
                "words": len(w), "word_length": chars / one(len(w)), "symbol_rate": sum(c in "#*$%&|<>" for c in t) / one(len(w)), "upper_rate": upper / one(chars),
                "dup_line_rate": (len(lines) - len(set(lines))) / one(len(lines)), "repeat_rate": len(cover) / one(len(w)), "words_per_line": len(w) / one(len(lines)),
            }
            holds = lambda c: (x[rule_ensemble.NAMES[c.feature]] > c.cut) == c.above
            total = model.bias + sum(weight for rule, weight in model.rules if all(map(holds, rule)))
            assert got[i].score == pytest.approx(1 / (1 + math.exp(-total))) and got[i].predicted == (got[i].score >= 0.7)


def test_classifier_of_little(docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = rule_ensemble.score(docs, rule_ensemble.train(docs, none)).collect()
    assert len(got) == docs.count() and all(r.score == 0.5 and r.predicted == 0 for r in got)


def test_mixture(docs):
    rates = {r.source: r for r in source_mixing.source_rates(docs, {"src0": 3, "src1": 1, "nothing": 1}, epochs=2).collect()}
    total = sum(r.n_bytes for r in rates.values())
    assert rates["src0"].rate * rates["src0"].n_bytes == pytest.approx(1.5 * total) and rates[""].rate == 0
    got = source_mixing.mix(docs, {"src0": 3, "src1": 1}, epochs=20).collect()
    copies = Counter(r.doc_id for r in got)
    assert all(r.n_copies == copies[r.doc_id] for r in got) and {r.source for r in got} <= {"src0", "src1"}


def test_poisson_counts(spark):
    d = spark.range(20000).selectExpr("id doc_id", "if(id < 100, 'small', 'large') source", "'abc' text")
    n = source_mixing.mix(d).groupBy("source").count().collect()
    for r in n:  # equal shares: 10000 each, give or take a few deviations; the small source's rate is 100
        assert abs(r["count"] - 10000) < 500


CLASHES = ["id", "n_words", "n_lines", "parts", "cdf", "row", "rest", "sig", "keys", "key", "n", "c", "l", "label", "rate", "weight", "start", "spans", "left", "words", "fail", "bits", "rank", "size"]


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Null and repeated ids, repeated rows, long texts with and without blanks, and columns whose names operators use inside."""
    rng = random.Random(31)
    words = " ".join(rng.choice(("one", "two", "three", "license", "x" * 30, "é", "<b>", "\n")) for _ in range(200_000))
    texts = [(1, "a plain text of a few words"), (1, "a plain text of a few words"), (1, "another"), (None, "a plain text of a few words"), (None, None), (2, None), (3, ""), (4, words), (5, "é字" * 250_000), (6, " " * 300_000), (7, "<p>" + "<a " * 200_000)]
    columns = ", ".join(f"{c} int" for c in CLASHES)
    rows = [(i, t, "s" if k % 2 else None, *range(k, k + len(CLASHES))) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, source string, {columns}").repartition(3).cache()


def _op_calls(docs, spark):
    path = public_tokenizers.path
    model = rule_ensemble.train(docs, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id bigint, quality int"))
    return {
        "op1": lambda: rule_ledger.apply_policy(rule_ledger.build_ledger(docs)),
        "op3": lambda: suffix_dedup.dedup_substrings(docs),
        "op4": lambda: token_counts.count_tokens(docs, path("piece_bpe_32k.model")),
        "op5": lambda: license_scan.scan_licenses(docs),
        "op6": lambda: html_extract.extract_text(docs.withColumnRenamed("text", "html")),
        "op7": lambda: byte_bpe.encode_documents(docs, path("byte_bpe_multi_50k.tiktoken")),
        "op9": lambda: rule_ensemble.score(docs, model),
        "op10": lambda: source_mixing.mix(docs, epochs=3),
    }


@pytest.mark.parametrize("op", ["op1", "op3", "op4", "op5", "op6", "op7", "op9", "op10"])
def test_odd_rows_keep_their_columns(op, odd_rows, spark):
    made = {"op1": {"n_words", "n_lines"}, "op5": {"n_words"}}.get(op, set())
    kept = [c for c in CLASHES if c not in made]
    out = _op_calls(odd_rows, spark)[op]()
    got = Counter(tuple(r) for r in out.select("doc_id", *kept).collect())
    expected = Counter(tuple(r) for r in odd_rows.select("doc_id", *kept).collect())
    if op == "op10":
        assert set(got) <= set(expected) and got
    else:
        assert got == expected


def test_odd_rows_of_pairs(odd_rows, spark):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(odd_rows).collect()}
    assert got == {i: i for i in range(1, 8)}
    codes = odd_rows.select("doc_id", F.length("text").cast("long").alias("code"), "n", "rank", "id")
    found = hamming_search.search(codes, codes.where("doc_id = 1"), k=3, id_column="doc_id").collect()
    assert {r.query_id for r in found} == {1} and max(Counter((r.query_id, r["rank"]) for r in found).values()) <= 3


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(name, spark, sf, tmp_path):
    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def plain_pipeline(spark, sf):
    """What the pipeline keeps, by brute force: each stage's rule applied in Python to what its predecessor kept."""
    import tiktoken

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    verdict = {r.doc_id: r.predicted for r in QUERIES["op9_quality_classifier"](spark, sf).select("doc_id", "predicted").collect()}
    texts = {i: r.text for i, r in docs.items() if verdict[i]}
    found = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert check_classes(texts, {r.doc_id: r.class_id for r in found}, 0.9) is not None
    texts = {r.doc_id: texts[r.doc_id] for r in found if r.doc_id == r.class_id}
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(t[k : k + 200] for t in raw.values() for k in range(len(t) - 199))
    left = {}
    for i, t in raw.items():
        mark = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                mark[k : k + 200] = b"\1" * 200
        rest = bytes(c for c, m in zip(t, mark, strict=True) if not m)
        if not any(mark) or rest.decode("utf-8", "ignore"):
            left[i] = rest.decode("utf-8", "ignore")
    total = Counter()
    for i, t in left.items():
        total[docs[i].source] += len(t.encode())
    out = Counter()
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.rank_encoder(path).rank, special_tokens={})
    for i, t in left.items():
        rate = sum(total.values()) / sum(n > 0 for n in total.values()) / total[docs[i].source]
        assert rate <= 64
        u = (int(hashlib.md5(f"mix-1|{i}|0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = cdf = np.exp(-rate)
        n = 0
        while cdf < u:
            n += 1
            p *= rate / n
            cdf += p
        ids = lib.encode_ordinary(t)
        out[i, docs[i].source, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += n
    return +out


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256) for r in got) == plain_pipeline(spark, sf)


def test_pipeline_keeps_one_of_each_crowded_pair(spark, sf):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t)) for i, t in crowd(31).items()]  # each pair of it shares a band
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert kept == set(range(90))


def test_pipeline_of_odd_tables(spark, sf, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = spark.sql("select * from values (1L, 'a text', 'en', 's', 6L), (1L, 'a text', 'en', 's', 6L), (null, 'b text', null, null, 6L), (2L, null, 'en', 's', null) t(doc_id, text, lang, source, n_chars)")
    for _, stage in corpus_pipeline.STAGES[1:4]:  # without labels the first stage keeps nothing
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == rows.columns and {r.doc_id for r in out.collect()} <= {1, 2, None}


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() > 0
    assert "ids_sha256" in docs.columns and docs.agg(F.sum("n_tokens")).first()[0] > 0
