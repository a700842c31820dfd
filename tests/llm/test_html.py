from tillroll.llm.html_text import extract, page_text


def test_implied_tags_lists_and_margins():
    got = page_text("<h1>Head &amp; x</h1><p>One <b>two<i> three</b> four<p>Para <br>next<ul><li>a<li>b<ul><li>c</ul><li>d</ul>"
                    "<ol start=3><li>x<li value=7>y</ol>")
    assert got == "Head & x\n\nOne two three four\n\nPara\nnext\n\n- a\n- b\n  - c\n- d\n\n3. x\n7. y"


def test_table_cells_are_aligned_and_rows_implied():
    got = page_text("<table><caption>Cap</caption><tr><th>Name<th>Value<tr><td>abc<td>1<tr><td colspan=2>wide one</table>after")
    assert got == "Cap\nName | Value\nabc  | 1\nwide one\n\nafter"
    assert page_text("<table><td>a<td>b<tr><td>long<td>c</table>") == "a    | b\nlong | c"


def test_hidden_text_is_left_out_and_shown_text_kept():
    got = page_text("<head><title>T</title></head><div hidden>no</div><div style='display: none'>no<p>no</p></div>"
                    "<span style='visibility:hidden'>no <b style='visibility:visible'>yes</b></span>"
                    "<script>if (a<b) '</p>'</script><details><summary>Sum</summary>no</details><noscript>no</noscript><!-- no -->tail")
    assert got == "yes\nSum\ntail"


def test_preformatted_text_keeps_its_space():
    assert page_text("a<pre>\n x   y\n  z</pre>b") == "a\n\n x   y\n  z\n\nb"


def test_broken_markup():
    for page, text in [("", ""), ("<", "<"), ("<p", ""), ("<a href='x", ""), ("<<<>>>", "<<<>>>"), ("</p></div>", ""),
                       ("&bogus; &lt;", "&bogus; <"), ("<!-- x", ""), ("a<br/>b<br><br>c", "a\nb\n\nc"),
                       ("<div>" * 5000 + "deep", "deep"), ("<i>" * 5000 + "deep", "deep"), ("<p>" * 3000 + "x", "x")]:
        assert page_text(page) == text
    assert page_text(None) is None


def test_quotes_open_values_only_behind_an_equals_sign():
    for page, text in [('<a href="x"">shown</a> and <b class="k">more</b>', "shown and more"),
                       ("<p title=it's>all of it<p>is here", "all of it\n\nis here"), ('<p x"y>a</p>"b', 'a\n\n"b'),
                       ('<a href=x="y>a</a> z">b', 'a z">b'), ('<a title = "1 > 0">a</a>', "a"), ("<a title=>b'c</a>", "b'c"),
                       ("<a b' c=\"d>e\">f</a>'", "f'"), ('<i x"hidden>a</i>', "a"), ('<i x"y hidden>a</i>b', "b"),
                       ("<img alt=\"it's 'so'\">", "it's 'so'"), ('<p title="x>lost', ""), ("<a" + " b'" * 50_000 + ">c", "c")]:
        assert page_text(page) == text


def test_what_is_no_part_of_a_table_stands_before_it():
    for page, text in [("<table><tbody><form><tr><td>x</td></tr></form></tbody></table>", "x"),
                       ("<table><tbody>stray<tr><td>x</table>", "stray\n\nx"),
                       ("<table><thead><tr><th>h</thead><tbody><div>d<tr><td>x<tr><td>y</div></table>z", "d\n\nh\nx\ny\n\nz"),
                       ("<table><tr><td>a</td><b>bold</b><td>c</tr> tail <tfoot><p>foot<p>more</table>",
                        "bold tail\n\nfoot\n\nmore\n\na | c"),
                       ("<table hidden><tbody><i>seen</i><tr><td>no</table>", "seen"),
                       ("<table><colgroup><col>text<tr><td>x</table>", "text\n\nx"),
                       ("<table><tr><td>a<table><tr><td>b</table>c<td>d</table>", "a  b  c | d"),
                       ("<table><tr><td>a<div><table><tr><td>b</table>c</div>d<td>e</table>", "a  b  c d | e"),
                       ("<table><tr><td>a</td><table><tr><td>b</table>", "a\n\nb"),
                       ("<table><template><tr><td>no</template>yes<tr><td>x</table>", "yes\n\nx"),
                       ("<tr><td>a<td>b<tr>c", "a\nb\nc"), ("<div>" * 148 + "<table><tbody><tr><td>x</table>y", "x\n\ny")]:
        assert page_text(page).split("\n") == text.split("\n"), page


def test_random_markup_keeps_its_words():
    import random
    rng = random.Random(3)
    names = "table thead tbody tfoot tr td th caption colgroup div p b form ul li span center h2".split()
    for _ in range(3000):
        parts = []
        for i in range(rng.randrange(1, 25)):
            parts += [f"<{rng.choice(['', '', '/'])}{rng.choice(names)}>"] + [f" w{i} "] * rng.randrange(2)
        words = [x for x in "".join(parts).replace(">", "> ").split() if x.startswith("w")]
        assert sorted(x for x in page_text("".join(parts)).split() if x.startswith("w")) == sorted(words), "".join(parts)


def test_all_visible_words_of_the_pages_are_kept(spark, sf):
    import re
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = extract(pages).collect()
    assert len(got) == pages.count() and set(got[0].asDict()) == {"page_id", "url", "text"}
    source = {r.page_id: r.html for r in pages.collect()}
    import html as H
    for r in got[:50]:
        body = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", source[r.page_id])
        words = H.unescape(re.sub(r"<[^>]+>", " ", body)).split()
        assert [w for w in r.text.split() if w not in ("-", "|")] == [w for w in words if w not in ("-", "|")]


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "<p>x" * 20_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = {(r.page_id, r.text_ and len(r.text_)): r.text for r in extract(pages).collect()}
    assert got == {(1, None): "a", (2, ""): "b", (None, 59_998): None}
    assert extract(pages.where("false")).count() == 0
