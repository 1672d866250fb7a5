from shotloom.llm import html_wrapper as H

SCHEMA = "page_id long, url string, html string"


def page(k, body, host="h"):
    return f"<!DOCTYPE html><html><head><title>t{k}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy {k}</div>{body}<footer>&copy; {host}</footer></body></html>"


def test_article_without_boilerplate():
    body = "<article><header><h1>Title &amp; more</h1></header><p><b>bold\n  text<br>next</b><p>second&nbsp;one</p><div class='comments'>no</div><aside>no</aside><form><p>no</p></form>tail</article>"
    assert H.extract(page(1, body)) == "Title & more\nbold text next\nsecond one\ntail"


def test_unclosed_cut_off_and_malformed():
    assert H.extract("<article><p><b>one<br><p>two &amp") == "one\ntwo &"
    assert H.extract("<article><p>a < b and c</p></section><p>d</article>") == "a < b and c\nd"
    assert H.extract("plain text only") == "plain text only"
    assert H.extract("") == ""
    assert H.extract("<script>var x = '<p>no</p>'") == ""


def test_page_header_and_notices_outside_the_article():
    text = H.extract("<body><header><h1>Site</h1></header><div id='sidebar'>x</div><div class='cookie-notice'>We</div><div class='main-text'><p>A</p><ul><li>one<li>two</ul></div><div role='navigation'>n</div></body>")
    assert text == "A\none\ntwo"


def test_attribute_values_are_no_attributes():
    text = H.extract("<article><p>see <a href='/the-hidden-valley'>the valley</a>, <b title='hidden gems' data-hidden=false>gems</b> and <a href=/x?id=share-1>more</a></p><div style='overflow:hidden' data-class='ad' data-role='menu' data-id=nav><p>body</p></div><p hidden>no</p><p aria-hidden=TRUE>no</p><p class=ad>no</p></article>")
    assert text == "see the valley, gems and more\nbody"


def test_names_count_as_a_whole_and_never_drop_the_article():
    for name in ("post has-sidebar", "no-sidebar", "content-with-sidebar", "with-menu", "share-price-report", "sidebar", "widget"):
        assert H.extract(f"<div class='{name}'><article class='{name}'><p>text</p></article></div><p>x</p>") == "text", name
        assert H.extract(f"<div id='{name}'><main><p>text</p></main></div><p>longer than that</p>") == "text", name
    assert H.extract("<div class='layout has-sidebar no-header'><p>text</p><div class='site-footer'>no</div><div class='sidebar-content'>no</div></div>") == "text"
    assert H.extract("<article><p>the text of it</p></article><div id=comments><article class=comment>no</article></div>") == "the text of it"


def test_simple_tree_matching_counts_order_preserving_pairs():
    a, b = H.parse("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>"), H.parse("<div><p>1</p><p>2</p><ul><li>y</li><li>z</li></ul></div>")
    assert H.match(a, b)[0] == 5  # root, div, first p, ul with one li


def test_constant_nodes_are_template_only_where_pages_differ():
    pages = [page(k, f"<div class=body><p>Share this story now</p><p>{'word%d ' % k * 30}</p></div>") for k in range(6)]
    wrapper = H.induce(pages)
    assert wrapper["template"] and H.extract(pages[3], wrapper) == " ".join(["word3"] * 30)
    copies = [page(k, "<article><p>" + "same text " * 30 + "</p></article>") for k in range(6)]
    assert H.extract(copies[0], H.induce(copies)) == " ".join(["same text"] * 30)


def test_query_form(spark):
    rows = [(1, "http://a.org/x", page(1, "<article><p>One</p></article>")), (1, "http://a.org/x", page(1, "<article><p>One</p></article>")), (2, None, "<p>Two"), (3, "http://A.org/y", None), (4, "http://b.org/", "")]
    long = "<article>" + "<p>text of a paragraph</p>" * 20000 + "</article>"
    df = spark.createDataFrame([*rows, (5, "http://b.org/l", long)], SCHEMA).selectExpr("html", "url", "page_id", "1 as host", "2 as text")
    got = {(r["page_id"], r["text"][:30], r["n_chars"]) for r in H.main_text(df).collect()}
    assert got == {(1, "One", 3), (2, "Two", 3), (3, "", 0), (4, "", 0), (5, "text of a paragraph\ntext of a ", 20 * 20000 - 1)}
    assert H.main_text(df).count() == 6
    assert H.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_hosts_take_the_joined_way(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_HOSTS", 0)
    rows = [(k, f"http://h{k % 2}.org/{k}", page(k, f"<div class=body><p>Share this</p><p>{'word%d ' % k * 30}</p></div>")) for k in range(12)]
    got = {r[0]: r[2] for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: " ".join([f"word{k}"] * 30) for k in range(12)}


def test_template_is_counted_over_all_pages_of_a_host(spark):
    rows = [(k, "http://h.org/", page(0, "<div class=body><p>Share this</p><p>" + "copy " * 60 + "</p></div>")) for k in range(100, 160)]
    want = {}
    for k in range(60):  # six layouts
        rows.append((k, "http://h.org/", page(k, f"<div class=body{k % 6}><p>Share this {k % 6}</p><p>{'word%d ' % k * 30}</p></div>")))
        want[k] = " ".join([f"word{k}"] * 30)
    rows += [(200 + k, "http://a.org/", page(k, f"<article><h2>Summary</h2><p>{'text%d ' % k * 30}</p></article>")) for k in range(5)]
    want |= {200 + k: "Summary\n" + " ".join([f"text{k}"] * 30) for k in range(5)}
    got = {r[0]: r[2] for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: got[k] for k in want} == want


def plain_match(a, b):
    """Simple tree matching by its definition."""
    if a.label != b.label:
        return 0
    x, y = ([c for c in n.children if isinstance(c, H.Node)] for n in (a, b))
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, c in enumerate(x):
        for j, d in enumerate(y):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_match(c, d))
    return best[-1][-1] + 1


def test_matching_equals_its_definition_on_random_trees():
    import random

    rng = random.Random(6)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in (rng.choice(["div", "section", "b", "i"]) for _ in range(rng.randrange(0, 4)))) if depth else ""

    for _ in range(150):
        a, b = H.parse(tree(4)), H.parse(tree(4))
        size, pairs = H.match(a, b)
        assert size == len(pairs) == plain_match(a, b)
        assert all(x.label == y.label and (x.parent is None or (x.parent, y.parent) in pairs) for x, y in pairs)


def test_deep_and_wide_pages():
    import time

    began = time.perf_counter()
    deep = ["<div>" * 100_000 + f"word{k}" for k in range(3)]
    assert H.extract(deep[0]) == "word0" and H.induce(deep)["fixed"] == []
    assert H.extract("<b>" * 100_000 + "x" + "</i>" * 100_000 + "<p>y" * 5) == "x\n" + "\n".join("y" * 5)
    wide = ["<ul>" + "".join(f"<li class=c{(j + k) % 7}>item {k} {j}</li>" for j in range(1500)) + "</ul>" for k in range(3)]
    H.induce(wide)
    H.induce(["".join(f"<div><p>{j}</p>{'<i>x</i>' * ((j * k) % 5)}</div>" for j in range(400)) for k in range(1, 4)])
    assert time.perf_counter() - began < 60


def test_wrapper_decides_where_names_mislead(spark):
    """An article element with the same words on every page is template, and the unnamed slot that varies is the text."""
    rows = [(k, "http://n.org/", page(k, f"<article class=intro><p>Join the club of readers today</p></article><div class=x1><p>{'real%d ' % k * 20}</p></div>")) for k in range(6)]
    got = {r[0]: r[2] for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: " ".join([f"real{k}"] * 20) for k in range(6)}
    assert H.extract(rows[0][2]) == "Join the club of readers today"  # by names alone
    same = [page(k, "<article><p>One story</p></article>") for k in range(6)]
    assert H.extract(same[0], H.induce(same)) == "One story"


def test_null_page_ids(spark):
    rows = [(None, None, "<article><p>a"), (None, "http://a.org", None)]
    assert sorted((r["page_id"], r["text"]) for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()) == [(None, ""), (None, "a")]


def test_slots_decide_before_names():
    """A short article beside an unnamed slot with most of the varying text isn't the region; two layouts have a region each."""
    rows = [page(k, f"<article class=teaser>see {k}</article><div class=x1><h1>Title {k}</h1><div class=x2><p>{'real%d ' % k * 40}</p></div></div>") for k in range(4)]
    rows += [page(k, f"<section class=y1><p>{'other%d ' % k * 40}</p><blockquote>quote {k}</blockquote></section><div class=y2>note</div>") for k in range(4)]
    wrapper = H.induce(rows)
    assert len(wrapper["regions"]) == 2
    for k in range(4):
        assert H.extract(rows[k], wrapper) == f"Title {k}\n" + " ".join([f"real{k}"] * 40)
        assert H.extract(rows[4 + k], wrapper) == " ".join([f"other{k}"] * 40) + f"\nquote {k}"


def test_pages_from_known_blocks_give_these_blocks(spark):
    """Brute force by construction: random blocks, rendered with references, markup and boilerplate around, come back whole, whatever holds them."""
    import html
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghéü中&<>'\"") for _ in range(rng.randrange(1, 9)))
    rows, want = [], {}
    for k in range(120):
        host, parts, texts = k % 4, [], []
        for tag in ["h1"] + [rng.choice(["p", "h2", "blockquote", "pre", "li"]) for _ in range(rng.randrange(2, 30))]:
            words = [word() for _ in range(rng.randrange(3, 40))]
            texts.append(" ".join(words))
            inner = rng.choice([" ", "\n\t", "<br>", "&nbsp;", " <!-- x --> "]).join(f"<b>{html.escape(w)}</b>" if rng.random() < 0.2 else html.escape(w) for w in words)
            parts.append(f"<ul><li>{inner}</ul>" if tag == "li" else f"<{tag}>{inner}" + ("" if tag == "p" and rng.random() < 0.5 else f"</{tag}>"))
        shell = ("<article>%s</article>", "<div class=k1><div class=k2>%s</div></div>", "<main>%s</main>", "<table><tr><td class=c>%s</td></tr></table>")[host]
        rows.append((k, f"https://h{host}.org/{k}", page(k, shell % "".join(parts), f"h{host}")))
        want[k] = "\n".join(texts)
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_every_page_of_a_host_is_learnt_from(spark, monkeypatch):
    """Six pages of a layout among two hundred others are seen only where all pages are counted; so too where tables are joined."""
    rows, want = [], {}
    for k in range(200):
        rows.append((k, "http://h.org/", page(k, f"<div class=z9><div class=x1><p>{'real%d ' % k * 30}</p></div></div>")))
        want[k] = " ".join([f"real{k}"] * 30)
    for k in range(200, 206):
        rows.append((k, "http://h.org/", page(k, f"<article class=intro><p>Join the club of readers today</p></article><div class=y1><p>{'rare%d ' % k * 30}</p></div>")))
        want[k] = " ".join([f"rare{k}"] * 30)
    for most in (5000, 0):
        monkeypatch.setattr(H, "BROADCAST_HOSTS", most)
        monkeypatch.setattr(H, "LEFT", 40 * most)
        got = {r[0]: r[2] for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == want


def test_what_follows_two_thousand_elements_is_learnt_from(spark):
    menu = "<div class=m>" + "<i>x</i>" * 2500 + "</div>"
    rows = [(k, "http://h.org/", page(k, f"{menu}<article><p>Join the club</p></article><div class=y1><p>{'real%d ' % k * 30}</p></div>")) for k in range(5)]
    got = {r[0]: r[2] for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: " ".join([f"real{k}"] * 30) for k in range(5)}


def test_wide_lists_of_distinct_items_are_aligned_in_time():
    import time

    began = time.perf_counter()
    wide = ["<ul>" + "".join(f"<li class=c{(j * 7 + k) % 990}>item <b class=d{(j + k) % 9}>{k}</b></li>" for j in range(2970)) + "</ul>" for k in range(4)]
    H.induce(wide)
    assert time.perf_counter() - began < 20


def test_long_lists_are_aligned_whole():
    """Parts of long lists that face each other don't hold what is shifted by more than a part."""
    import random

    rng = random.Random(4)
    for turn in range(12):
        page = lambda names: H.parse("<ul>" + "".join(f"<li class=c{k}>{k}<b class=d{rng.randrange(3)}>x</b></li>" for k in names) + "</ul>")
        names = [rng.randrange(9 if turn % 2 else 400) for _ in range(rng.randrange(90, 200))]
        other = [rng.randrange(500, 600) for _ in range(rng.randrange(40, 120))] + [k for k in names if rng.random() < 0.9] + [600]
        a, b = page([700, *names]), page(other)
        size, pairs = H.match(a, b)
        assert size == len(pairs) == plain_match(a, b)
    menu = lambda n: "".join(f"<i class=m{k}>x</i>" for k in range(n))
    a, b = (H.parse(f"<div>{x}<p class=t>text</p>{y}</div>") for x, y in ((menu(90), "<b>1</b>"), ("<em>0</em>" * 300, "<s>2</s>")))
    assert any(x.label == "p.t" for x, _ in H.match(a, b)[1])


def test_rows_of_numbers_equal_the_definition_on_random_trees(monkeypatch):
    monkeypatch.setattr(H, "TABLE", 0)
    test_matching_equals_its_definition_on_random_trees()


def test_the_text_far_down_one_page_and_high_up_another_is_a_slot(spark):
    """Links that no two pages share stand before and behind it, so many that parts of the lists would not face each other."""
    rows, want = [], {}
    for k in range(6):
        before = "".join(f"<a href=/{j} class=m{k}-{j}></a>" for j in range(100 if k == 0 else 20 * k))
        after = "".join(f"<a href=/{j} class=n{k}-{j}></a>" for j in range(0 if k == 0 else 150))
        rows.append((k, "http://h.org/", f"<body><div class=z>{before}<article><p>Join the club</p></article><div class=y1><p>{'real%d ' % k * 30}</p></div>{after}</div></body>"))
        want[k] = " ".join([f"real{k}"] * 30)
    got = {r[0]: r[2] for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_lists_of_thousands_take_memory_by_their_length():
    import time
    import tracemalloc

    import numpy as np

    rng, n = np.random.default_rng(2), 20_000
    gains, (left, right) = np.eye(50, dtype=np.int64), rng.integers(0, 50, (2, n))
    began = time.perf_counter()
    tracemalloc.start()
    pairs = H.aligned(gains, left, right)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20 and time.perf_counter() - began < 60
    assert all(left[i] == right[j] for i, j in pairs) and all(p[0] > q[0] and p[1] > q[1] for p, q in zip(pairs, pairs[1:]))
