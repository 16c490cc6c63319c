"""Licences, URLs, quality, HTML and tokens."""

import math
import random
from collections import Counter, defaultdict

import pytest
from inspectra.llm import html, licenses, quality, tokens, urls

DOCS = "doc_id long, text string, source string, lang string, n_chars long, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), "x") for i, t, s in rows], DOCS)


def test_license_lines_paragraphs_and_nothing(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 100)
    rows = [(0, "Some text.\nReleased under the MIT License.\nMore.", "a"), (1, None, None), (2, "", "a"), (3, mit.replace("hereby ", ""), "a"), (4, "word " * 500, "a"), (5, "x\n\nlicensed UNDER cc by-nc 4.0\n\nreleased under the mit license", "a")]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert got[0]["license"] == "MIT" and got[0]["dice"] == 1.0 and got[0]["n_matches"] == 2
    assert got[1]["license"] is None and got[2]["license"] is None and got[4]["n_matches"] == 0
    assert got[3]["license"] == "MIT" and 0.9 < got[3]["dice"] < 1
    assert got[5]["licenses"] == "CC-BY-NC-4.0,MIT"


def test_dice_equals_brute_force(spark):
    def pairs(t):
        w = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        return list(zip(w, w[1:]))

    dice = lambda a, b: 2 * len(set(a) & set(b)) / (len(set(a)) + len(set(b)))
    texts = [" ".join(t.split()[: k % 40 + 4]) for k, (_, t) in enumerate(licenses.TEMPLATES * 3)]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        p, best = pairs(t), 0
        for _, x in licenses.TEMPLATES:
            n = len(pairs(x))
            best = max([best, dice(p, pairs(x)), *(dice(p[k : k + n], pairs(x)) for k in range(max(len(p) - n, 0) + 1))])
        assert (got[i]["dice"] or 0) == pytest.approx(best if best >= licenses.THRESHOLD else 0, abs=1e-6)


def test_licenses_of_several_paragraphs_and_within_sentences(spark):
    whole = {n: t for n, t in licenses.TEMPLATES if len(t) > 300}
    paragraphs = lambda t: "\n\n".join(" ".join(t.split()[k : k + 40]) for k in range(0, len(t.split()), 40))
    filler = "some words of another kind here " * 200
    rows = [(i, f"{filler}\n\n{paragraphs(t)}\n\n{filler}", "a") for i, t in enumerate(whole.values())]
    rows += [(100, f"{filler} this file is part of foo and is released under the MIT License, {filler}", "a"), (101, "licensed under " * 3000, "a"), (102, filler * 20, "a")]
    rows += [(103, "Released under the MIT License. " * 3, "a")] * 2
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    for i, name in enumerate(whole):
        assert (got[i]["license"], got[i]["dice"]) == (name, 1.0), name
    assert got[100]["licenses"] == "MIT" and got[101]["license"] is None and got[102]["license"] is None and got[103]["license"] == "MIT"


def test_license_scan_of_odd_tables(spark):
    clash = spark.createDataFrame([(1, "Released under the MIT License.", 7, "x")], "doc_id long, text string, found long, License string")
    out = licenses.scan(clash)
    assert out.columns == ["doc_id", "text", "found", "license", "dice", "n_matches", "licenses"] and out.first()["found"] == 7
    assert licenses.scan(clash.limit(0)).count() == 0 and licenses.scan(clash, templates=()).first()["license"] is None


def test_url_rules_and_mined_rules(spark):
    pages = [(i, f"https://www.spam{i % 3}.example.org/en/{i}") for i in range(30)] + [(100 + i, f"http://good.example.org/de/{i}") for i in range(30)]
    pages += [(200, "https://a.example.com/en/x"), (201, "https://WWW.example.com/en/x?q"), (202, "https://b.com/q"), (203, "http://x.net/es/1#f"), (204, None), (205, "nothing"), (206, "http://notexample.com/en/"), (207, "http://x.net")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in pages], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(i, i < 100) for i, _ in pages[:60]] + [(204, None)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in urls.filter_urls(df, labels).collect()}
    assert len(got) == len(pages)
    assert all(got[i]["verdict"] == ("block" if i < 100 else "allow") for i, _ in pages[:60])
    assert (got[200]["rule"], got[200]["verdict"]) == ("example.com/en/", "block")
    assert (got[201]["rule"], got[201]["verdict"], got[201]["host"]) == ("www.example.com/en/", "allow", "www.example.com")
    assert (got[202]["rule"], got[203]["rule"], got[206]["rule"], got[207]["rule"]) == ("com/", "net/es/", "com/", None)
    assert got[204]["host"] == got[205]["host"] == "" and got[204]["verdict"] == "allow"
    assert got[207]["path"] == ""
    assert urls.filter_urls(df.limit(0), labels.limit(0)).count() == 0


def test_mined_rules_equal_brute_force(spark):
    import itertools

    baskets = [(["a", "b", "c"], True), (["a", "b"], True), (["a", "c"], False), (["b", "c"], True), (["b"], False), (["a", "b", "d"], True)] * 5
    df = spark.createDataFrame([([*t, urls.BAD] if bad else t,) for t, bad in baskets], "items array<string>")
    got = {tuple(r["tokens"]): r["confidence"] for r in urls.mine_rules(df, 0.1, 0.7).collect()}
    expected = {}
    for n in range(1, 4):
        for combo in itertools.combinations("abcd", n):
            held = [bad for t, bad in baskets if set(combo) <= set(t)]
            if held and sum(held) / len(baskets) >= 0.1 and sum(held) / len(held) >= 0.7:
                c = sum(held) / len(held)
                if not any(set(x) < set(combo) and v >= c for x, v in expected.items()):
                    expected[combo] = c
    assert got == pytest.approx(expected)


def test_quality_measures():
    assert quality.measure(None) == (0,) * 6
    text = "a b c a b c\n\nx $#\na b c a b c é"
    n, chars, symbols, dup, repeats, lines = quality.measure(text)
    assert (n, symbols, dup, lines) == (14, 2, 0, 3)
    assert chars == sum(len(w) for w in text.replace("\n", " ").split(" "))
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    assert repeats == len(covered)
    assert quality.measure("x y\nx y\n \nx y")[3] == 2


def test_quality_keeps_clean_documents_of_bad_hosts(spark):
    good = " ".join(f"word{i} again" for i in range(60))
    bad = " ".join(f"## $$ w{i} | |" for i in range(60))
    rows = [(i, bad, "spam") for i in range(20)] + [(20, good, "spam"), (21, good, None), (22, None, None), (23, "short", "ok"), (24, "same same same " * 50, "ok")] + [(30 + i, good, "ok") for i in range(20)]
    got = {r["doc_id"]: r for r in quality.judge(docs(spark, rows)).collect()}
    assert not any(got[i]["kept"] for i in range(20)) and got[20]["kept"] and got[21]["kept"]
    assert got[22]["base_failed"] and got[23]["base_failed"] and got[24]["base_failed"] and all(got[30 + i]["kept"] for i in range(20))
    assert quality.judge(docs(spark, []).limit(0)).count() == 0


def test_quality_host_verdicts_decide_on_single_failures(spark):
    clean = " ".join(f"word{i} other{i}" for i in range(60))
    marked = clean + " #" * 15  # fails the rule of symbols alone
    rows = [(1000 * h + i, marked if i < k else clean, f"host{h}") for h, k in enumerate([1, 2, 1, 0, 2, 1, 40, 1]) for i in range(60)]
    got = {r["doc_id"]: r for r in quality.judge(docs(spark, rows)).collect()}
    assert {i // 1000 for i, r in got.items() if r["host_bad"]} == {6}
    assert sorted(i for i, r in got.items() if not r["kept"]) == list(range(6000, 6040))
    assert all(r["n_failed"] == (1 if r["text"] == marked else 0) for r in got.values())


def test_host_rates_shrink_less_where_hosts_differ_more(spark):
    def verdicts(hosts):
        rows = [(h, i < k) for h, (k, n) in enumerate(hosts) for i in range(n)]
        return {r["host"]: r for r in quality.host_verdicts(spark.createDataFrame(rows, "host int, x boolean"), "host", ["x"]).collect()}

    alike = verdicts([(10, 100)] * 20 + [(2, 10)])
    assert alike[20]["rate_x"] == pytest.approx((2 + 1000 * 202 / 2010) / 1010, abs=1e-3) and not any(r["bad_x"] for r in alike.values())
    apart = verdicts([(0, 100), (50, 100)] * 10 + [(8, 10)])
    assert apart[20]["rate_x"] > 0.5 and apart[20]["bad_x"] and apart[1]["bad_x"] and not apart[0]["bad_x"]
    assert not any(r["bad_x"] for r in verdicts([(5, 5)]).values()) and not any(r["bad_x"] for r in verdicts([(0, 5), (0, 9)]).values())


def test_quality_of_odd_tables(spark):
    rows = [(1, "a b c " * 400_000, "h", True, 5, 6), (1, "a b c " * 400_000, "h", False, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bad boolean, measured int, Host_Key int")
    out = quality.judge(df)
    assert out.columns[:6] == df.columns and sorted(r["measured"] for r in out.collect()) == [5, 7]


def test_main_text_cases():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>menu</a></nav>
    <div class="cookie-notice">We use cookies</div><div id="page"><article class="post"><h1>T &amp; A</h1><p>One <b>b</b>old<br>two
    three<p>Four &lt;x&gt;<div class="ad-slot">Buy</div><form>f</form><ul><li>a<li>b</ul><script>var x="</p>";</script><section id="comments"><p>nice</p></section></article>
    <div class="sidebar">side</div></div><footer>foot</footer></body></html>"""
    assert html.main_text(page) == "T & A\nOne bold two three\nFour <x>\na\nb"
    assert html.main_text(None) == html.main_text("") == ""
    assert html.main_text("<article><p>cut &am") == "cut &am"
    assert html.main_text("<p>plain<div>more</div>end <b") == "plain\nmore\nend"
    assert html.main_text("<article>a</article><article>b</article>") == "a\nb"


def test_style_tree_drops_what_all_pages_of_a_host_share(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><div class='top'>Same words everywhere</div><div class='text'><p>Page {i} is its own</p></div></body>") for i in range(20)]
    rows += [(50, "http://other.org/", "<body><div class='top'>Same words everywhere</div></body>"), (51, None, None)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert got[3]["text"] == "Page 3 is its own" and got[3]["n_chars"] == 17
    assert got[50]["text"] == "Same words everywhere" and got[51]["text"] == "" and got[51]["n_chars"] == 0
    assert html.extract(df.limit(0)).count() == 0


def test_style_tree_looks_inside_articles(spark):
    rows = [(i, f"http://h.org/{i}", f"<article><p>Page {i} is its own</p><p class='fine'>Same words everywhere</p></article>") for i in range(20)]
    rows += [(100 + i, f"http://i.org/{i}", f"<div>{i}</div><article><p>One text for all</p></article>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Page 3 is its own" and got[103] == "One text for all"
    assert html.main_text("<div><p>The long text of this page</p></div><article>teaser</article>") == "The long text of this page\nteaser"


def test_copies_of_a_page_count_once_in_the_style_tree(spark):
    page = lambda i: f"<body><div class='text'><p>Page {i} is its own</p></div></body>"
    rows = [(i, f"http://h.org/{i}", page(0)) for i in range(12)]
    rows += [(100 + i, f"http://i.org/{i}", page(max(i, 70))) for i in range(100)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Page {0 if i < 100 else max(i - 100, 70)} is its own" for i in got} and len(got) == 112


def test_broken_markup_and_names_that_only_look_like_noise():
    assert html.main_text("<article><p>x</p><p>5 < 6 is true and more") == "x\n5 < 6 is true and more"
    assert html.main_text("plain a < b and c") == "plain a < b and c"
    assert html.main_text("<article><div class='share-price'>12</div><p class='related-work'>y</p><p class='related-posts'>z</p></article>") == "12\ny"
    deep = "<div>" * 20_000 + "end"
    assert html.main_text(deep) == "end" and html.main_text("<p>" * 20_000 + "end") == "end"
    assert html.main_text("<b>" * 20_000 + "x" + "</b>" * 20_000 + "<p>y") == "x\ny"
    assert html.main_text("<a href='x>unclosed quote</a> <p>after</p>") != "" and html.main_text("x" * 2_000_000) == "x" * 2_000_000


def test_tree_alone_removes_boilerplate_inside_and_outside_articles(spark):
    """No noise tag and no noise word: a strip of links, a notice and a box inside the article, all shared by the host."""
    draw = random.Random(4)
    prose = lambda: " ".join(f"w{draw.randint(0, 9999)}" for _ in range(30))
    links = lambda: "".join(f"<li><a href='/'>{draw.choice('alpha beta gamma delta'.split())}</a></li>" for _ in range(6))
    texts = [[prose() for _ in range(draw.randint(1, 4))] for _ in range(30)]
    page = lambda p: f"<div class='x1'><ul>{links()}</ul></div><div class='x2'>All rights are with us</div><article><h2>{p[0][:20]}</h2>{''.join(f'<p>{t}</p>' for t in p)}<div class='x3'>Read this paper daily</div></article>"
    rows = [(i, f"http://h.org/{i}", page(p)) for i, p in enumerate(texts)] + [(99, "http://small.org", page(texts[0]))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert all(got[i] == "\n".join([p[0][:20].strip(), *p]) for i, p in enumerate(texts))
    assert got[99].endswith("Read this paper daily")
    low = {r["host"]: set(r["places"]) for r in html.style_tree(df.selectExpr("'h.org' host", "html"), "host", "html").collect()}["h.org"]
    mixed = [(i, f"http://h.org/{i}", f"<div>Home<p>{prose()}</p></div>") for i in range(12)]
    kept = html.extract(spark.createDataFrame(mixed, "page_id long, url string, html string")).collect()
    assert all(r["text"] in mixed[r["page_id"]][2] and not r["text"].startswith("Home") and r["n_chars"] > 60 for r in kept)
    blocks, _ = html.parse(rows[0][2])
    gone = html.removed_by_tree(blocks, low)
    assert [b.text for b, g in zip(blocks, gone) if not g] == [texts[0][0][:20].strip(), *texts[0]] and sum(gone) == 8


def test_importance_equals_brute_force(spark):
    draw = random.Random(5)
    pages = [f"<div class='a'><p>{draw.choice('xyz')}</p>{'<p>tail</p>' * draw.randint(0, 2)}</div><div class='b'>{draw.randint(0, 9)}<ul><li>{draw.choice('pq')}</li><li>r</li></ul></div>" for _ in range(40)]
    pages += pages[:5]
    got = {r["place"]: r["importance"] for r in html.importance(observed_rows(spark, pages)).collect()}
    seen: dict = {}
    for blocks, nodes in map(html.parse, set(pages)):
        seen[str([(b.place, b.text) for b in blocks])] = (blocks, nodes)
    df, m, child = Counter(), Counter(), defaultdict(Counter)
    for blocks, nodes in seen.values():
        df.update({(b.place, b.text) for b in blocks})
        m.update({b.place for b in blocks})
        for place, sequence in {(n.place, n.sequence) for n in nodes if n.sequence}:
            child[place][sequence] += 1
    own = {p: 1 - sum(n * math.log(n) for (q, _), n in df.items() if q == p) / sum(n for (q, _), n in df.items() if q == p) / math.log(m[p]) for p in m}
    for p, rating in own.items():
        assert got[p] == pytest.approx(rating)
    outer = defaultdict(set)
    for blocks, _ in seen.values():
        for b in blocks:
            for x in html.above(b.node):
                outer[x].add(b.place)
    for p, styles in child.items():
        n = sum(styles.values())
        many = len({i for i, (_, nodes) in enumerate(seen.values()) if any(x.place == p and x.sequence for x in nodes)})
        entropy = -sum(k / n * math.log(k / n) for k in styles.values()) / math.log(many)
        below = {q: sum(c for (r, _), c in df.items() if r == q) for q in outer[p]}
        content = sum(own[q] * c for q, c in below.items()) / sum(below.values())
        assert got[p] == pytest.approx((1 - html.GAMMA ** len(styles)) * min(entropy, 1) + html.GAMMA ** len(styles) * content)
    assert set(got) == set(own) | set(child)


def observed_rows(spark, pages):
    known: set = set()
    return spark.createDataFrame([x for p in pages for x in html.observed("h", *html.parse(p), known)], html.SEEN)


def test_main_text_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "http://h", "<p>a", [1], "k", "m"), (1, "http://h", "<p>a", [1], "k", "m"), (None, None, "", None, None, None)], "page_id long, url string, html string, places array<int>, host_key string, Main_Text string")
    out = html.extract(df)
    assert out.columns == ["page_id", "url", "places", "host_key", "Main_Text", "text", "n_chars"]
    assert sorted(r["text"] for r in out.collect()) == ["", "a", "a"]


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = ["", "plain words here", "  two  spaces \n\n lines\t tab ", "a<|endoftext|>b c", "it's we'll  x　 y", "naïve éèê 漢字 テスト", "x" * 5000, "a b " * 3000, " lead", "trail ", "1 234,5 %%% $", "\x1c a \x1d b"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(99, None, "s")]
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs(spark, rows), path).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(whole.encode(t, add_special_tokens=False)), t
        assert got[i]["n_bytes"] == len(t.encode()) and got[i]["over_limit"] == (got[i]["n_tokens"] > 512)
    assert got[99]["n_tokens"] == 0
    assert "".join(tokens.pieces(texts[2])) == texts[2]


def test_columns_named_like_our_own(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, "http://a.com/x", "plain text", 5, 6, 7)] * 2, "page_id long, url string, text string, _t int, met_url int, Token_Counts int")
    labels = spark.createDataFrame([(1, True)], "page_id long, bad boolean")
    out = urls.filter_urls(df, labels)
    assert out.columns[:6] == df.columns and [r["met_url"] for r in out.collect()] == [6, 6]
    counted = tokens.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"))
    assert counted.columns[:6] == df.columns and [(r["_t"], r["Token_Counts"], r["n_tokens"]) for r in counted.collect()] == [(5, 7, 2)] * 2
    assert tokens.count_tokens(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    clash = spark.createDataFrame([(1, "http://a.com/x", "u", "t")], "page_id long, _url string, url string, tokens string")
    assert urls.filter_urls(clash, labels).count() == 1


def test_license_names_with_quotes_ties_and_long_texts(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    templates = (("O'Neil \\ Sons", " ".join(words)), ("Twin", " ".join(words)))
    rows = [(1, " ".join(words), "a"), (2, "filler text here. " * 40_000 + "\n" + " ".join(words) + "\n" + "more filler. " * 40_000, "a")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs(spark, rows), templates=templates).collect()}
    assert got == {1: "O'Neil \\ Sons", 2: "O'Neil \\ Sons"}  # of equal matches the first name
